"""Removal of lines that many documents share, found with two Bloom filters.

A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least ``least`` code
points that stand in at least ``documents`` documents lose all their lines except in the largest
document that holds them.

1. Every task hashes the keys of its documents and notes the slots of all hashes (once-seen) and of
   those that two of its documents hold (twice-seen). Slots are cut into segments and travel as
   packed differences, about two bytes a slot. One task per segment merges: what a later filter has
   in common with the once-seen filter so far goes to the twice-seen filter. A key of two documents
   is thus always in the second filter; one in about seventy others is by chance.
2. The twice-seen filter, folded to two bits a line, goes to all tasks in passes of at most
   ``FILTER_BYTES``, which is one pass for some 250 million lines. Only lines that it suspects leave
   their task.
3. Suspects are counted exactly by key text, each document once; of a key that is confirmed the largest
   document is chosen. What is to go is joined back to the documents.

A document is a ``doc``: rows that share one count once. Rows without ``doc`` hold nothing and keep all
lines. A null or empty text is one empty line. Equal rows have equal results; further columns of the
input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from shiftlens.llm.common import kept_aside

BLANKS = " \t\n\v\f\r"
LEAST = 20
DOCUMENTS = 3

#: Slots of the filters for each line, and how many of them a hash takes.
SLOTS = 16
#: Segments are few and of 2^20 to 2^28 slots.
SEGMENTS = 4096
SMALLEST, LARGEST = 20, 28
#: The twice-seen filter is folded so many times (as a power of two): few of its slots are taken.
FOLDS = 3
#: Of the folded filter, the most that goes to the tasks at once.
FILTER_BYTES = 64 << 20
#: Documents whose lines are cut at a time.
DOCS = 512
#: Hashes that a task gathers before it hands over its slots.
FLUSH = 1 << 22

SECOND = np.uint64(0x9E3779B97F4A7C15)  # odd, so that the second slot depends on all bits


class Layout:
    """How hashes map to segments and slots, for a number of lines."""

    def __init__(self, lines: int) -> None:
        wanted = max(1, SLOTS * lines)
        self.bits = min(LARGEST, max(SMALLEST, math.ceil(math.log2(wanted / SEGMENTS))))
        self.segments = math.ceil(wanted / (1 << self.bits))
        self.folded = 1 << (self.bits - FOLDS)

    def segment(self, hashes: np.ndarray) -> np.ndarray:
        """Rises with the hash."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)

    def slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return hashes & mask, (hashes * SECOND) >> np.uint64(64 - self.bits)


def _packed(slots: np.ndarray) -> bytes:
    """Rising slots as differences, byte by byte of each, compressed."""
    steps = np.diff(slots, prepend=np.uint64(0)).astype("<u4")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64)


def _lines(texts: pa.Array, least: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of every document's long keys, each once: the document's place, the key, the key's hash."""
    lines = pc.split_pattern(texts, "\n")
    keys = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=BLANKS))
    long = pc.greater_equal(pc.utf8_length(keys), least)
    places = np.asarray(pc.list_parent_indices(lines).filter(long))
    keys = keys.filter(long)
    hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys.cast(pa.binary()).to_pylist()], np.uint64)
    first = np.flatnonzero(~pd.DataFrame({"place": places, "hash": hashes}).duplicated().to_numpy())
    return places[first], keys.take(pa.array(first)), hashes[first]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, DOCS) for at in range(0, len(batch), DOCS))


def twice_seen(docs: DataFrame, layout: Layout, least: int = LEAST) -> DataFrame:
    """``segment, bits``: the folded twice-seen filter of the keys in ``text``."""

    def slots_of(hashes: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate(layout.slots(hashes)))

    def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_over(held: list[np.ndarray]) -> pa.RecordBatch:
            hashes, times = np.unique(np.concatenate(held), return_counts=True)
            segments, starts = np.unique(layout.segment(hashes), return_index=True)
            own = [slice(*x) for x in zip(starts, [*starts[1:], len(hashes)], strict=True)]
            once = [_packed(slots_of(hashes[s])) for s in own]
            twice = [_packed(slots_of(hashes[s][times[s] > 1])) for s in own]
            return pa.RecordBatch.from_arrays(
                [pa.array(segments.astype(np.int64)), pa.array(once), pa.array(twice)],
                ["segment", "once", "twice"],
            )

        held, size = [], 0
        for batch in _few(batches):
            held.append(_lines(batch.column("text"), least)[2])
            size += len(held[-1])
            if size >= FLUSH:
                yield handed_over(held)
                held, size = [], 0
        if size:
            yield handed_over(held)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = (np.zeros(1 << layout.bits, bool) for _ in range(2))
        for slots, repeated in zip(map(_unpacked, rows["once"]), rows["twice"], strict=True):
            twice[slots[once[slots]]] = True
            twice[_unpacked(repeated)] = True
            once[slots] = True
        folded = twice.reshape(-1, layout.folded).any(axis=0)
        bits = np.packbits(folded, bitorder="little").tobytes()
        return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "bits": [bits]})

    found = docs.select("text").mapInArrow(noted, "segment bigint, once binary, twice binary")
    return found.groupBy("segment").applyInPandas(merged, "segment bigint, bits binary")


def _suspects(docs: DataFrame, layout: Layout, filters: DataFrame, first: int, least: int) -> DataFrame:
    """``doc, row, key`` of the keys that a stretch of the twice-seen filter holds."""
    stretch = max(1, FILTER_BYTES * 8 // layout.folded)
    size = layout.folded // 8
    bits = bytearray(min(stretch, layout.segments - first) * size)
    for row in filters.where(F.col("segment").between(first, first + stretch - 1)).toLocalIterator():
        at = (row["segment"] - first) * size
        bits[at : at + size] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)
        for batch in _few(batches):
            places, keys, hashes = _lines(batch.column("text"), least)
            segments = layout.segment(hashes).astype(np.int64) - first
            inside = (segments >= 0) & (segments < len(held) // size)
            at = np.where(inside, segments, 0) * layout.folded
            for slots in layout.slots(hashes):
                bit = at + (slots % np.uint64(layout.folded)).astype(np.int64)
                inside &= (held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            found = pa.array(np.flatnonzero(inside))
            rows = batch.take(pa.array(places).take(found))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc"), rows.column("row"), keys.take(found)], ["doc", "row", "key"]
            )

    schema = f"doc {docs.schema['doc'].dataType.simpleString()}, row string, key string"
    return docs.mapInArrow(probe, schema)


def _cut(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    """Texts without the lines of these keys; null where the text is."""
    blanks, out = BLANKS.encode(), []
    for text, keys in zip(texts, dropped, strict=True):
        if text is None:
            out.append((None, None))
            continue
        gone, lines = {k.encode() for k in keys}, text.encode().split(b"\n")
        kept = [x for x in lines if x.strip(blanks).lower() not in gone]
        out.append((len(lines) - len(kept), b"\n".join(kept).decode()))
    return pd.DataFrame(out, columns=["n_dropped", "kept"])


def without_repeated_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    documents: int = DOCUMENTS,
) -> DataFrame:
    """``doc, n_lines, n_dropped, kept`` for every row of ``docs``; ``kept`` is the text that stays."""
    rows = docs.select(F.col(key).alias("doc"), F.md5(text).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    asked = rows.where(F.col("doc").isNotNull() & (F.length("text") >= least))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    layout = Layout(asked.agg(F.coalesce(F.sum(breaks), F.lit(0))).first()[0])
    filters = kept_aside(twice_seen(asked, layout, least))
    stretch = max(1, FILTER_BYTES * 8 // layout.folded)
    suspects = None
    for first in range(0, layout.segments, stretch):
        found = _suspects(asked, layout, filters, first, least)
        suspects = found if suspects is None else suspects.unionByName(found)
    suspects = kept_aside(suspects)
    # written, so that the join below has an exchange on both sides, whose large keys can be split
    repeated = kept_aside(
        suspects.select("key", "doc")
        .distinct()
        .groupBy("key")
        .agg(F.count("*").alias("held"), F.max("doc").alias("last"))
        .where(F.col("held") >= documents)
        .select("key", "last")
    )
    gone = suspects.join(repeated, "key").where(F.col("doc") < F.col("last"))
    dropped = gone.groupBy("doc", "row").agg(F.collect_set("key").alias("dropped"))
    judged = rows.join(dropped, ["doc", "row"], "left")
    without = F.pandas_udf(_cut, "n_dropped bigint, kept string")
    cut = judged.withColumn(
        "cut", without(F.when(F.col("dropped").isNotNull(), F.col("text")), F.col("dropped"))
    )
    return cut.select(
        "doc",
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
        F.coalesce("cut.n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce("cut.kept", "text").alias("kept"),
    )
