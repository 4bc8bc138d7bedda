"""Passages repeated across documents, by hashes of windows in content-cut blocks.

Words are runs of characters that are not white space. Every document is cut into reference blocks
at places that its own words choose: a block is the longest stretch of windows of ``WINDOW`` words
that share the smallest hash of ``GRAM`` words, its anchor. Equal passages are cut alike wherever
they stand, so a passage of an earlier document can only lie in blocks of the same anchor.

The index holds, for every anchor, the earliest document and whether all its blocks are the same
text. A whole block that an earlier document has is a duplicate span at once; where blocks of one
anchor differ, their windows are indexed and compared one by one. No text is parsed into factors:
spans are unions of repeated windows. Documents are compared by id: only a smaller id counts as
earlier, and windows are judged on the input.

Null and empty texts have no words. Texts of fewer than ``WINDOW`` words keep them all. Rows with a
null id keep all words and are no one's reference; rows of one id never remove each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shiftlens.llm.common import kept_aside

WINDOW = 50
GRAM = 8
#: Buckets of the filter on documents to read again: its size whatever the input.
SIEVE = 1 << 20
#: Words whose hashes a task keeps.
CACHE_WORDS = 100_000

BLOCK = "doc bigint, text_hash bigint, anchor bigint, block bigint, start int, windows int"
PLACE = "doc bigint, text_hash bigint, anchor bigint, content bigint, start int"
KEPT = "doc bigint, n_words bigint, n_removed bigint, kept string"
DIGEST = "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string"

BASE = 0x9E3779B97F4A7C15


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Hashes:
    return _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, made as long as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, factor in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                steps = np.full(2 * n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


@lru_cache(maxsize=1)
def _powers() -> _Powers:
    return _Powers()


class Parsed:
    """Window minima and stretch hashes of one text."""

    def __init__(self, text: str | None) -> None:
        split = (text or "").encode().split()
        self.n = len(split)
        self.windows = max(0, self.n - WINDOW + 1)
        if self.windows:
            h = np.fromiter(map(_words().__getitem__, split), np.uint64, self.n)
            up, self.down = _powers().get(self.n + 1)
            self.sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mix(h) * up[:-1], out=self.sums[1:])
            self.anchors = self._anchors(h)

    def _anchors(self, h: np.ndarray) -> np.ndarray:
        """The smallest gram hash of each window."""
        grams = h[: self.n - GRAM + 1]
        for i in range(1, GRAM):
            grams = _mix(grams) ^ h[i : self.n - GRAM + 1 + i]
        least, width, whole = _mix(grams), 1, WINDOW - GRAM + 1
        while 2 * width <= whole:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        return np.minimum(least[: self.windows], least[whole - width : whole - width + self.windows])

    def content(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from ``start`` to ``end``, wherever they stand."""
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return _mix(value + (end - start).astype(np.uint64) * np.uint64(BASE))

    def blocks(self) -> tuple[np.ndarray, ...]:
        """Anchor, content, first window and number of windows of each block."""
        new = np.r_[True, self.anchors[1:] != self.anchors[:-1]]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], self.windows]
        return self.anchors[start], self.content(start, end + WINDOW - 1), start, end - start


def _joined(values: list[np.ndarray], kind: type) -> pa.Array:
    whole = np.concatenate(values)
    return pa.array(whole.view(kind) if whole.dtype == np.uint64 else whole.astype(kind))


NO_BLOCKS = (*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 2)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, parts = [], [[], [], [], []]
        for text in batch.column("text"):
            own = Parsed(text.as_py())
            found = own.blocks() if own.windows else NO_BLOCKS
            lengths.append(len(found[0]))
            for part, values in zip(parts, found, strict=True):
                part.append(values)
        if not lengths:
            continue
        row = pa.array(np.repeat(np.arange(len(lengths)), lengths))
        kinds = (np.int64, np.int64, np.int32, np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(row) for c in ("doc", "text_hash")),
                *(_joined(p, k) for p, k in zip(parts, kinds, strict=True)),
            ],
            ["doc", "text_hash", "anchor", "block", "start", "windows"],
        )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the blocks that are asked for."""
    for batch in batches:
        for row, text, asked in zip(
            range(batch.num_rows), batch.column("text"), batch.column("asked").to_pylist(), strict=True
        ):
            own = Parsed(text.as_py())
            start = np.concatenate([np.arange(a["start"], a["start"] + a["windows"]) for a in asked])
            at = pa.array(np.full(len(start), row))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(at) for c in ("doc", "text_hash")),
                    pa.array(own.anchors[start].view(np.int64)),
                    pa.array(own.content(start, start + WINDOW).view(np.int64)),
                    pa.array(start.astype(np.int32)),
                ],
                ["doc", "text_hash", "anchor", "content", "start"],
            )


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[list[bytes], list[bytes]]:
    """All words, and those outside the spans of windows."""
    words = (text or "").encode().split()
    kept, at = [], 0
    for span in sorted(spans or [], key=lambda s: s["start"]):
        kept += words[at : max(at, span["start"])]
        at = max(at, span["start"] + span["windows"] + WINDOW - 1)
    return words, kept + words[at:]


def _remove(digest: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, out = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words, kept = kept_words(text.as_py(), spans.as_py())
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                out.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(out, pa.string()),
                ],
                ["doc", "n_words", "n_removed", "kept_sha256" if digest else "kept"],
            )

    return remove


def _sieved(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents that may be wanted; the filter has at most ``SIEVE`` rows."""
    spot = F.pmod(F.xxhash64("doc", "text_hash"), F.lit(SIEVE)).alias("spot")
    spots = kept_aside(wanted.select(spot).distinct())
    return docs.withColumn("spot", spot).join(F.broadcast(spots), "spot", "left_semi").drop("spot")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """``doc, text_hash, start, windows``; ``docs`` has ``doc, text_hash, text``."""
    row, span = ["doc", "text_hash"], ["start", "windows"]
    blocks = kept_aside(docs.where(F.col("doc").isNotNull()).mapInArrow(_cut, BLOCK))
    # one partial row for each anchor and task, however many documents share it
    index = (
        blocks.groupBy("anchor")
        .agg(
            F.min("doc").alias("first"),
            F.max("doc").alias("last"),
            (F.min("block") != F.max("block")).alias("differ"),
        )
        .where("first < last")
        .select("anchor", "first", "differ")
    )
    shared = kept_aside(blocks.join(kept_aside(index), "anchor"))
    alike = shared.where("not differ and doc > first").select(*row, *span)

    unlike = shared.where("differ").drop("first", "differ")
    firsts = kept_aside(unlike.groupBy("anchor", "block").agg(F.min("doc").alias("first")))
    judged = kept_aside(unlike.join(firsts, ["anchor", "block"]))
    repeated = judged.where("doc > first").select(*row, *span)

    # the first document of each block: its windows may lie in other blocks of the anchor
    asked = kept_aside(
        judged.where("doc = first").groupBy(*row).agg(F.collect_list(F.struct(*span)).alias("asked"))
    )
    texts = _sieved(docs, asked).dropDuplicates(row)
    places = kept_aside(texts.join(asked, row).mapInArrow(_places, PLACE))
    earliest = (
        places.groupBy("anchor", "content")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        .where("first < last")
        .drop("last")
    )
    within = (
        places.join(kept_aside(earliest), ["anchor", "content"])
        .where("doc > first")
        .select(*row, "start", F.lit(1).alias("windows"))
    )
    return alike.unionByName(repeated).unionByName(within)


def without_repeats(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", digest: bool = False
) -> DataFrame:
    """``doc, n_words, n_removed`` and ``kept`` words, or with ``digest`` their ``kept_sha256``."""
    own = docs.select(
        F.col(doc).cast("bigint").alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    )
    # a document has at most one span a window
    spans = (
        duplicate_spans(own)
        .groupBy("doc", "text_hash")
        .agg(F.collect_set(F.struct("start", "windows")).alias("spans"))
    )
    met = own.join(spans, ["doc", "text_hash"], "left").select("doc", "text", "spans")
    return met.mapInArrow(_remove(digest), DIGEST if digest else KEPT)
