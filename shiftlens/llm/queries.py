"""The registered queries of this subpackage: ``name -> (run, oracle SQL or None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.llm import (
    bpe,
    decontaminate,
    exact_topk,
    hard_negatives,
    line_dedup,
    ngram_join,
    pii,
    secret_scan,
    sql,
    substrings,
    token_counts,
    toxicity,
    url_filter,
    whitening,
)
from shiftlens.llm.common import sha, table

Runner = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs, items))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", secret_scan.secret_spans(F.col("text")).alias("found")
    )
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return docs.select(
        "doc_id",
        *(
            F.size(secret_scan.of_kind(found, kind)).cast("bigint").alias(f"n_{kind}")
            for kind in secret_scan.BASE_KINDS
        ),
        sha(secret_scan.listed(base)).alias("base_sha256"),
        secret_scan.listed(found).alias("spans"),
    )


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("doc", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scores = docs.select("doc_id", toxicity.scored(F.col("text"), model).alias("score"))
    return scores.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = spark.sparkContext.broadcast(bpe.read_vocabulary(vocabulary("word_bpe_49k.json")))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe.digested(F.col("text"), content).alias("d")).select(
        "doc_id", "d.*"
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.fit(docs))
    return found.select(
        "doc_id",
        *(
            F.size(secret_scan.of_kind(F.col("base"), kind)).cast("bigint").alias(f"n_{kind}")
            for kind in pii.BASE_KINDS
        ),
        sha(pii.listed(F.col("base"))).alias("base_sha256"),
        pii.listed(F.concat("base", "added")).alias("spans"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("class_doc").alias("class_id"),
        "n_links",
        F.col("group_doc").alias("group_id"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", url_filter.judged(F.col("url")).alias("j")).select(
        "page_id", "j.*"
    )


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.integers(table(spark, sf_dir, "embeddings"))
    return exact_topk.top_k(exact_topk.rows_of(vectors, 5), F.col("vec_id") % 50 == 0, 5)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = spark.sparkContext.broadcast(token_counts.piece_scores(vocabulary("piece_bpe_32k.model")))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_counts.token_counts(F.col("text"), scores).alias("c")).select(
        "doc_id", "c.*"
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_lines", "n_dropped", sha(F.col("kept")).alias("kept_sha256")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings")
    rows = hard_negatives.stored(vectors, F.col("vec_id"), label, F.col("embedding"))
    return hard_negatives.mined(rows, F.col("id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whole(table(spark, sf_dir, "embeddings"))
    return whitening.whitened(rows, whitening.refined(rows)).withColumnRenamed("id", "vec_id")


RUNNERS: dict[str, Runner] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_secret_scan,
        op3_substrings,
        op4_toxicity,
        op5_bpe,
        op6_pii,
        op7_ngram_join,
        op8_url_filter,
        op9_exact_topk,
        op10_token_counts,
        op11_line_dedup,
        op12_hard_negatives,
        op13_whitening,
    )
}


def load() -> dict[str, tuple[Runner, str | None]]:
    return {name: (run, sql.ORACLES.get(name)) for name, run in RUNNERS.items()}
