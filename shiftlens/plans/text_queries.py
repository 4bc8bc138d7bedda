"""Retrieval over documents and pages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.functions.text import tokens
from shiftlens.operators import (
    pair_ranks,
    retrieval as R,
    search_index as I,
    segmentation as G,
    vector_index as V,
)
from shiftlens.plans.binding import table
from shiftlens.plans.registry import add
from shiftlens.session import shared_folder
from shiftlens.sources.corpus import read_markdown, search_sections, write_section_index
from shiftlens.sources.tables import spread, stored

TOP_K = 4


def rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(table(spark, folder, name))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as Markdown: the source as title, every further line as a section."""
    docs = rows(spark, folder, "documents")
    body = F.regexp_replace("text", "\n", "\n## ")
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n"), body)
    return docs.select(F.col("doc_id").alias("doc"), text.alias("text"))


def pages_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as Markdown: the first heading as title, paragraphs as sections."""
    html = F.col("html")
    title = F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)
    body = F.regexp_replace(html, "<p>", "\n## ")
    body = F.regexp_replace(body, "<[^>]*>", " ")
    return rows(spark, folder, "pages").select(
        F.col("page_id").alias("doc"),
        F.concat(F.lit("# "), title, F.lit("\n"), body).alias("text"),
    )


def chunks(spark: SparkSession, folder: str, keep: bool = True) -> DataFrame:
    """All documents, tokenised once and stored as an index is, if they are to be kept; some have no vector."""
    held = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")
    )
    docs = rows(spark, folder, "documents").select("doc_id", tokens(F.col("text")).alias("terms"))
    found = docs.join(held, "doc_id", "left").withColumnRenamed("doc_id", "chunk_id")
    return stored(found) if keep else found


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs = rows(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"))
    held = rows(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")
    )
    return docs.join(held, "chunk_id")


def all_documents(spark: SparkSession, folder: str) -> DataFrame:
    return stored(
        rows(spark, folder, "documents").select(
            F.col("doc_id").alias("chunk_id"), tokens(F.col("text")).alias("terms")
        )
    )


def term_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("terms")
    )


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark passage, with the mean vector of one label as its direction."""
    means = (
        table(spark, folder, "embeddings")
        .select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
        .select("label", F.transform("v", lambda e: e["m"]).alias("vec"))
    )
    return (
        term_queries(spark, folder)
        .join(means, F.pmod("query_id", F.lit(10)) == F.col("label"))
        .select("query_id", "terms", "vec")
    )


TOKEN = r"[\p{L}\p{N}_]+"  # no Han text in these tables
BLANK = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}')"


def _strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _sections_sql(source: str) -> str:
    """``source`` yields doc, text with text starting '# title\\n'."""
    return f"""parts AS (SELECT doc, {_strip_sql("regexp_extract(text, '^#[ ]+([^' || chr(10) || ']+)', 1)")} AS title,
        string_split(replace(text, chr(10) || '## ', chr(1) || '## '), chr(1)) AS ps FROM ({source})),
      cut AS (SELECT doc, title, generate_subscripts(ps, 1) - 1 AS part, unnest(ps) AS raw FROM parts),
      bare AS (SELECT *, {_strip_sql("raw")} AS body FROM cut),
      named AS (SELECT *, starts_with(body, '## ') AS headed, {_strip_sql("string_split_regex(substr(body, 4), '[' || chr(10) || chr(13) || chr(12) || chr(11) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233) || ']')[1]")} AS nm,
        {_strip_sql("regexp_replace(body, '^#[ ]+[^' || chr(10) || ']+' || chr(10) || '?', '')")} AS intro FROM bare),
      sections AS (SELECT doc, part, CASE WHEN headed THEN nm ELSE '概述' END AS section,
        '【' || title || CASE WHEN headed THEN ' / ' || nm ELSE '' END || '】' || chr(10)
        || CASE WHEN headed THEN body ELSE intro END AS text FROM named WHERE headed OR intro <> '')"""


MARKDOWN_SQL = """SELECT doc_id AS doc,
  '# ' || source || chr(10) || replace(text, chr(10), chr(10) || '## ') AS text FROM documents"""
PAGES_SQL = """SELECT page_id AS doc, '# ' || regexp_extract(html, '<h1>([^<]*)</h1>', 1) || chr(10)
  || regexp_replace(replace(html, '<p>', chr(10) || '## '), '<[^>]*>', ' ', 'g') AS text FROM pages"""

DOC_TERMS = f"dt AS (SELECT doc_id AS c, {_tokens_sql('text')} AS ts FROM documents)"
BM25_SQL = f"""post AS (SELECT c, len(ts) AS dl, unnest(ts) AS t FROM dt),
  tf AS (SELECT c, dl, t, count(*) AS f FROM post GROUP BY ALL),
  rawidf AS (SELECT t, ln((SELECT count(*) FROM dt)-count(*)+0.5)-ln(count(*)+0.5) AS w
    FROM tf GROUP BY t),
  idf AS (SELECT t, CASE WHEN w < 0 THEN 0.25*(SELECT avg(w) FROM rawidf) ELSE w END AS w
    FROM rawidf),
  qt AS (SELECT item_id AS q, unnest({_tokens_sql('text')}) AS t FROM benchmark),
  avgdl AS (SELECT avg(len(ts)) AS a FROM dt),
  bm AS (SELECT q, c, round(sum(w*f*2.5/(f+1.5*(0.25+0.75*dl/a))), 9) AS sparse
    FROM qt JOIN idf USING (t) JOIN tf USING (t), avgdl GROUP BY q, c)"""
DENSE_SQL = """ue AS (SELECT vec_id AS c, list_transform(embedding, lambda x:
    CAST(x AS DOUBLE)/sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE)*CAST(y AS DOUBLE))))) AS u FROM embeddings),
  cells AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x
    FROM embeddings),
  means AS (SELECT label, list(m ORDER BY i) AS mv FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m
    FROM cells GROUP BY ALL) GROUP BY label),
  uq AS (SELECT label, list_transform(mv, lambda x: x/sqrt(list_sum(list_transform(mv, lambda y: y*y)))) AS u
    FROM means),
  de AS (SELECT item_id AS q, ue.c, round(list_sum(list_transform(list_zip(ue.u, uq.u),
    lambda z: z[1]*z[2])), 9) AS dense
    FROM benchmark JOIN uq ON item_id % 10 = label, ue JOIN documents ON ue.c = doc_id)"""
# a document without a vector comes behind all that have one
RANKED_SQL = """pairs AS (SELECT item_id AS q, dt.c, coalesce(dense, -2) AS dense,
      coalesce(sparse, 0) AS sparse FROM benchmark CROSS JOIN dt
    LEFT JOIN de ON de.q = item_id AND de.c = dt.c LEFT JOIN bm ON bm.q = item_id AND bm.c = dt.c),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dense DESC, c) AS dr,
    row_number() OVER (PARTITION BY q ORDER BY sparse DESC, c) AS sr FROM pairs),
  fused AS (SELECT *, 1.0/(60+dr)+1.0/(60+sr) AS f FROM ranked)"""


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    found, asked = chunks(spark, folder, keep=False), stored(queries(spark, folder))
    lists = [
        (R.dense_ranks(found.select("chunk_id", "vec"), asked), "dense_rank"),
        (R.sparse_ranks(found, asked), "sparse_rank"),
    ]
    null = found.where("chunk_id IS NULL").count() + asked.where("query_id IS NULL").count()
    return R.fuse(lists, parts=None if null else max(1, math.ceil(found.count() / pair_ranks.TOGETHER)))


def _section_index(spark: SparkSession, folder: str) -> str:
    """The folder of a written index; a section has the vector of its document."""
    held = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc"), F.col("embedding").alias("vec")
    )
    path = shared_folder(spark)
    write_section_index(markdown(spark, folder), held, path)
    return path


def _index_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = _section_index(spark, folder)
    kept = spark.read.parquet(f"{path}/sections").select("chunk_id", "doc")
    placed = spark.read.parquet(f"{path}/chunks").select("chunk_id", "length", "has_vector")
    return kept.join(placed, "chunk_id").groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_sections"),
        F.sum("length").alias("n_terms"),
        F.count_if("has_vector").alias("n_vectors"),
    )


def _folder_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of a folder with a file for every page."""
    path = shared_folder(spark)
    # tasks put their own files in place; with the first algorithm the driver moves each of them
    writer = pages_markdown(spark, folder).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy("doc").text(path)
    return R.split_sections(read_markdown(spark, path, "*.txt"))


# Stand-ins for letters, as the tables hold no Han text: runs of words without their spaces.
LETTERS, CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这为之大来以个中上们到说国和地也"


def han(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in Han characters, with a run for every line."""
    text = F.replace(F.lower("text"), F.lit(" "), F.lit(""))
    return rows(spark, folder, "documents").select(
        "doc_id", F.translate(text, LETTERS, CHARACTERS).alias("text")
    )


def _segmented(spark: SparkSession, folder: str) -> DataFrame:
    """How documents are cut up, and that nothing of them is lost."""
    docs = han(spark, folder)
    found = G.segmented(docs, G.learn(docs))
    whole = docs.select("doc_id", F.concat_ws("", G.runs(F.col("text"))).alias("characters"))
    return found.join(whole, "doc_id").select(
        "doc_id",
        F.length("characters").alias("n_characters"),
        (F.concat_ws("", "terms") == F.col("characters")).cast("string").alias("whole"),
        (F.size(F.filter("terms", lambda t: (F.length(t) > G.LONGEST) & t.rlike(G.HAN))) == 0)
        .cast("string")
        .alias("short"),
    )


HAN_SQL = f"""hr AS (SELECT unnest(regexp_extract_all(translate(replace(lower(text), ' ', ''),
    '{LETTERS}', '{CHARACTERS}'), '[{CHARACTERS}]+')) AS run FROM documents),
  hc AS (SELECT run, count(*) AS times FROM hr GROUP BY 1),
  hg AS (SELECT substr(run, i, z) AS gram, z, sum(times) AS n FROM (SELECT run, times, z,
      unnest(range(1, len(run) - z + 2)) AS i FROM hc, (VALUES (1), (2), (3), (4)) s(z) WHERE len(run) >= z)
    GROUP BY 1, 2 HAVING z = 1 OR sum(times) >= {G.LEAST}),
  ht AS (SELECT sum(n) AS total FROM hg WHERE z = 1),
  hp AS (SELECT gram, n, unnest(range(1, z)) AS cut FROM hg WHERE z > 1),
  hb AS (SELECT hp.gram, hp.n, min(CAST(hp.n AS DOUBLE) * total / (CAST(a.n AS DOUBLE) * b.n)) AS bond
    FROM hp JOIN hg a ON a.gram = substr(hp.gram, 1, cut) JOIN hg b ON b.gram = substr(hp.gram, cut + 1), ht
    GROUP BY 1, 2),
  hw AS (SELECT gram, n FROM hb WHERE bond >= {G.COHESION} UNION ALL SELECT gram, n FROM hg WHERE z = 1)"""


DEPTH = R.candidate_depth(TOP_K)
# sections as chunks: numbered by document and part, each with its document's vector
SECTION_SQL = (
    _sections_sql(MARKDOWN_SQL),
    "ns AS (SELECT row_number() OVER (ORDER BY doc, part) - 1 AS c, * FROM sections)",
    f"dt AS (SELECT c, {_tokens_sql('text')} AS ts FROM ns)",
    BM25_SQL,
    DENSE_SQL.replace("de AS (", "dd AS ("),
    "de AS (SELECT q, ns.c, dense FROM dd JOIN ns ON dd.c = ns.doc)",
    RANKED_SQL,
)


def register() -> None:
    for name, frame, sql in (
        ("documents", markdown, MARKDOWN_SQL),
        ("pages", pages_markdown, PAGES_SQL),
    ):
        add(
            f"sections_{name}",
            "T1",
            "doc:i, part:i, section, text",
            lambda s, d, frame=frame: R.split_sections(frame(s, d)),
            "SELECT * FROM sections",
            (_sections_sql(sql),),
        )
    add(
        "folder_sections",
        "S6 T1",
        "doc:i, part:i, section, text",
        _folder_sections,
        "SELECT * FROM sections",
        (_sections_sql(PAGES_SQL),),
    )
    add(
        "section_index",
        "S7 T1 T2",
        "doc:i, n_sections:i, n_terms:i, n_vectors:i",
        _index_counts,
        f"""SELECT doc, count(*) AS n_sections, sum(len({_tokens_sql("text")})) AS n_terms,
          count(vec_id) AS n_vectors FROM sections LEFT JOIN embeddings ON vec_id = doc GROUP BY 1""",
        (_sections_sql(MARKDOWN_SQL),),
    )
    add(
        "section_search",
        "S7 T7 L4",
        "query_id:i, hit_rank:i, doc:i, section, text, score:4",
        lambda s, d: search_sections(s, _section_index(s, d), queries(s, d), TOP_K),
        f"""SELECT query_id, hit_rank, doc, section, text, score FROM (SELECT q AS query_id,
          row_number() OVER (PARTITION BY q ORDER BY f DESC, c) AS hit_rank, c, f AS score FROM fused)
        JOIN ns USING (c) WHERE hit_rank <= {TOP_K}""",
        SECTION_SQL,
    )
    add(
        "document_terms",
        "T2",
        "chunk_id:i, n_terms:i, n_distinct:i, first_term, last_term",
        lambda s, d: all_documents(s, d).select(
            "chunk_id",
            F.size("terms").alias("n_terms"),
            F.size(F.array_distinct("terms")).alias("n_distinct"),
            F.coalesce(F.array_min("terms"), F.lit("")).alias("first_term"),
            F.coalesce(F.array_max("terms"), F.lit("")).alias("last_term"),
        ),
        """SELECT c AS chunk_id, len(ts) AS n_terms, len(list_distinct(ts)) AS n_distinct,
          coalesce(list_min(ts), '') AS first_term, coalesce(list_max(ts), '') AS last_term FROM dt""",
        (DOC_TERMS,),
    )
    add(
        "learned_words",
        "T2",
        "word, n:i, score:6",
        lambda s, d: G.learn(han(s, d)),
        "SELECT gram AS word, n, ln(n / total) AS score FROM hw, ht",
        (HAN_SQL,),
    )
    add(
        "segmented_terms",
        "T2",
        "doc_id:i, n_characters:i, whole, short",
        _segmented,
        f"""SELECT doc_id, len(regexp_replace(translate(lower(text), '{LETTERS}', '{CHARACTERS}'),
            '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS n_characters, 'true' AS whole, 'true' AS short
        FROM documents""",
        (),
    )
    add(
        "term_weights",
        "T5",
        "term, idf:6",
        lambda s, d: R.term_weights(all_documents(s, d)),
        "SELECT t AS term, CASE WHEN w < 0 THEN 0.25 * avg(w) OVER () ELSE w END AS idf FROM raw",
        (
            DOC_TERMS,
            "held AS (SELECT unnest(list_distinct(ts)) AS t FROM dt)",
            """raw AS (SELECT t, ln((SELECT count(*) FROM dt) - count(*) + 0.5) - ln(count(*) + 0.5) AS w
              FROM held GROUP BY t)""",
        ),
    )
    add(
        "bm25_scores",
        "T5",
        "query_id:i, chunk_id:i, sparse:6",
        lambda s, d: R.bm25(all_documents(s, d), term_queries(s, d)),
        "SELECT q AS query_id, c AS chunk_id, sparse FROM bm",
        (DOC_TERMS, BM25_SQL),
    )
    add(
        "dense_scores",
        "T3 T4",
        "query_id:i, chunk_id:i, dense:6",
        lambda s, d: R.dense(vectors(s, d), queries(s, d)),
        "SELECT q AS query_id, c AS chunk_id, dense FROM de",
        (DENSE_SQL,),
    )
    everything = (DOC_TERMS, BM25_SQL, DENSE_SQL, RANKED_SQL)
    add(
        "dense_ranks",
        "W1 T4",
        "query_id:i, chunk_id:i, dense:6, dense_rank:i",
        lambda s, d: R.dense_ranks(vectors(s, d), queries(s, d)),
        """SELECT q AS query_id, c AS chunk_id, dense,
          row_number() OVER (PARTITION BY q ORDER BY dense DESC, c) AS dense_rank FROM de""",
        (DENSE_SQL,),
    )
    add(
        "dense_first",
        "T4 T7",
        "query_id:i, chunk_id:i, dense:6, dense_rank:i",
        lambda s, d: V.nearest(V.blocks(vectors(s, d)), queries(s, d), DEPTH),
        f"""SELECT * FROM (SELECT q AS query_id, c AS chunk_id, dense,
          row_number() OVER (PARTITION BY q ORDER BY dense DESC, c) AS dense_rank FROM de)
        WHERE dense_rank <= {DEPTH}""",
        (DENSE_SQL,),
    )
    add(
        "sparse_first",
        "T5 T7",
        "query_id:i, chunk_id:i, sparse:6, sparse_rank:i",
        lambda s, d: I.sparse_first(I.build(chunks(s, d)), queries(s, d), DEPTH)[0],
        f"""SELECT q AS query_id, c AS chunk_id, sparse, sr AS sparse_rank FROM ranked
        WHERE sr <= {DEPTH}""",
        everything,
    )
    add(
        "sparse_ranks",
        "W2 T5",
        "query_id:i, chunk_id:i, sparse:6, sparse_rank:i",
        lambda s, d: R.sparse_ranks(chunks(s, d, keep=False), queries(s, d)),
        "SELECT q AS query_id, c AS chunk_id, sparse, sr AS sparse_rank FROM ranked",
        everything,
    )
    add(
        "fused_ranking",
        "T6",
        "query_id:i, chunk_id:i, fused:8",
        _fused,
        "SELECT q AS query_id, c AS chunk_id, f AS fused FROM fused",
        everything,
    )
    add(
        "hybrid_search",
        "T7 L4",
        "query_id:i, hit_rank:i, chunk_id:i, score:4",
        lambda s, d: I.hybrid_search(chunks(s, d), queries(s, d), TOP_K),
        f"""SELECT * FROM (SELECT q AS query_id, row_number() OVER (PARTITION BY q
          ORDER BY f DESC, c) AS hit_rank, c AS chunk_id, f AS score FROM fused)
        WHERE hit_rank <= {TOP_K}""",
        everything,
    )
