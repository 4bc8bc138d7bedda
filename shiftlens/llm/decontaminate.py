"""Benchmark passages in documents, by a prefix-filtered set join; built-in functions only.

Words are runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII. A window is
``WINDOW`` consecutive words of an item, or the whole item where it has fewer. Every window has
shingles of ``SHINGLE`` consecutive words, or one of all its words where it has fewer. Containment
of a whole window makes the necessary prefix one shingle long: the one that the fewest places of
the documents hold. Documents meet windows on that shingle alone; the position of the shingle in
the window bounds where the window can start and end, and the words are then compared one by one.

The windows, each with its prefix and items, reach the documents in blocks whose bytes are measured
and below ``BLOCK_BYTES``; each block is a broadcast join, so no document word is ever shuffled. What
is shuffled are hits, distinct by place before they leave a task.

Null and empty texts have no words and no hits; items without words, or without an id, have no
windows. Repeated documents each get their own row, repeated items count once. A window that several
items share is held once with all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.llm.common import kept_aside, sha

WINDOW = 10
SHINGLE = 5
#: Bytes of windows, as estimated from their words, in one broadcast.
BLOCK_BYTES = 32 << 20

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` by what it holds, which is matched several times as fast.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lowered = F.translate(text, UPPER, LOWER)
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array())


def _shingle(own: Column, start: Column, width: int) -> Column:
    """Hash of ``width`` words from ``start`` (0-based) on."""
    return F.xxhash64(*(F.get(own, start + i) for i in range(width)))


def windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``words, items, width``: distinct windows with their items and the width of their shingles."""
    own = items.where(F.col(item).isNotNull()).select(
        F.col(item).alias("item"), words(F.col(text)).alias("all")
    )
    long = F.least(F.size("all"), F.lit(WINDOW))
    starts = own.where(F.size("all") > 0).select(
        "item", "all", F.explode(F.sequence(F.lit(0), F.size("all") - long)).alias("at")
    )
    placed = starts.select("item", F.slice("all", F.col("at") + 1, long).alias("words"))
    return (
        placed.groupBy("words")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    )


def _window_shingles(found: DataFrame, width: int) -> DataFrame:
    """Every shingle of every window of one width, with its offset."""
    offsets = F.sequence(F.lit(0), F.size("words") - width)
    return (
        found.where(F.col("width") == width)
        .select("*", F.explode(offsets).alias("offset"))
        .withColumn("shingle", _shingle(F.col("words"), F.col("offset"), width))
    )


def _document_shingles(docs: DataFrame, width: int) -> DataFrame:
    """Every shingle of every document, with its position; ``docs`` has ``key, all``."""
    starts = F.sequence(F.lit(0), F.size("all") - width)
    return (
        docs.where(F.size("all") >= width)
        .select("key", "all", F.explode(starts).alias("at"))
        .withColumn("shingle", _shingle(F.col("all"), F.col("at"), width))
    )


def _blocks(frame: DataFrame, size: Column, by: Column) -> list[DataFrame]:
    """The frame in parts of at most about ``BLOCK_BYTES`` each, dealt by a hash."""
    total = frame.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = -(-total // (BLOCK_BYTES // 2)) if total > BLOCK_BYTES else 1
    return [frame.where(F.pmod(F.xxhash64(by), F.lit(n)) == i) for i in range(n)] if n > 1 else [frame]


def prefixes(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """Each window with the one of its shingles that is rarest in the documents."""
    of_windows = _window_shingles(found, width)
    distinct = kept_aside(of_windows.select("shingle").distinct())
    counts = [
        _document_shingles(docs, width)
        .select("shingle")
        .join(F.broadcast(block), "shingle")
        .groupBy("shingle")
        .agg(F.count("*").alias("places"))
        for block in _blocks(distinct, F.lit(24), F.col("shingle"))
    ]
    rare = of_windows.join(reduce(DataFrame.unionByName, counts), "shingle", "left")
    order = F.struct(F.coalesce("places", F.lit(0)), "shingle", "offset")
    return rare.groupBy("words", "items").agg(F.min_by(F.struct("shingle", "offset"), order).alias("p")).select(
        "words", "items", "p.shingle", "p.offset"
    )


def hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``key, start, long, items``: every occurrence of a window in a document."""
    widths = sorted(r["width"] for r in found.select("width").distinct().collect())
    parts = []
    for width in widths:  # 1 to SHINGLE, usually one
        chosen = kept_aside(prefixes(docs, found, width))
        size = 64 + 16 * F.size("items") + F.size("words") * 16 + F.length(F.array_join("words", ""))
        for block in _blocks(chosen, size.cast("bigint"), F.col("words")):
            met = _document_shingles(docs, width).join(F.broadcast(block), "shingle")
            start, long = F.col("at") - F.col("offset"), F.size("words")
            fits = (start >= 0) & (start + long <= F.size("all"))
            same = F.slice("all", start + 1, long) == F.col("words")
            parts.append(
                met.where(fits)
                .where(same)
                .select("key", start.alias("start"), long.alias("long"), "items")
            )
    if not parts:
        none = docs.sparkSession.createDataFrame([], "start int, long int, items array<bigint>")
        return docs.select("key").limit(0).join(none, F.lit(True))
    return reduce(DataFrame.unionByName, parts)


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Documents under a key of their id and text, so that repeated ids stay apart."""
    key = F.struct(F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("text"))
    return docs.select(key.alias("key"), words(F.col(text)).alias("all"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated``: one row per document.

    ``items`` are the ids of the items with a window in the document, as sorted strings.
    """
    keyed = _keyed(docs, doc, text)
    found = kept_aside(windows(items, item, item_text))
    places = F.transform(
        F.sequence(F.col("start"), F.col("start") + F.col("long") - 1),
        lambda p: F.struct(F.lit(0).alias("kind"), p.cast("string").alias("value")),
    )
    named = F.transform(
        "items", lambda i: F.struct(F.lit(1).alias("kind"), i.cast("string").alias("value"))
    )
    of_document = (
        hits(keyed, found)
        .select("key", F.explode(F.concat(places, named)).alias("m"))
        .select("key", "m.*")
        .distinct()  # within the task first, where the windows over one place lie together
        .groupBy("key")
        .agg(
            F.count_if(F.col("kind") == 0).alias("n_hit"),
            F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.col("value")))).alias("items"),
        )
        .select(F.col("key").alias("hit_key"), "n_hit", "items")
    )
    lengths = keyed.select("key", F.size("all").cast("bigint").alias("n_words"))
    same = lengths["key"].eqNullSafe(of_document["hit_key"])
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return lengths.join(of_document, same, "left").select(
        F.col("key.doc").alias("doc_id"),
        F.col("key.text").alias("text_hash"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        listed.alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, all their columns."""
    bad = (
        contamination(docs, items)
        .where("contaminated")
        .select(F.col("doc_id").alias("bad_doc"), F.col("text_hash").alias("bad_text"))
        .distinct()
    )
    same = docs["doc_id"].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(docs["text"]) == bad["bad_text"])
    return docs.join(bad, same, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        sha(F.array_join("items", ",")).alias("items_sha256"),
        "contaminated",
    )
