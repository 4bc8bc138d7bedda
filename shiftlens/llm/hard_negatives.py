"""Hard negatives by inner product, filtered by summaries of vector segments.

Every vector is cut into 1, 4, 16, ... segments, and of each segment its mean and its deviation (the length
of what is left of the segment without its mean) are stored beside the vector. The product of two
segments is the product of their means times their length, plus or minus at most the product of their
deviations; summed over the segments this bounds a score from below and above. A search goes from the
coarse to the fine summaries and keeps what its bounds allow:

- positives, the best of an anchor's own label: whatever reaches the k-th lower bound so far;
- negatives, the best of other labels with ``low * positive <= 100 * score <= high * positive``: whatever
  may lie in that range, and not below its k-th lower bound among those that surely do.

Exact scores are formed for the rest alone. Anchors and candidates meet in pairs of blocks of bounded
size, both dealt by their content; a pair hands over at most k rows for each anchor and range.

Vectors become whole numbers, floor(256 x). Rows with a null id, label or vector or a null or non-finite
component take no part. Equal rows are stored once with their number, and count as many: a copy of an
anchor is one of its candidates, and every copy of an anchor has its own result rows. Vectors of different
lengths are not compared; empty ones score 0. Higher scores come first, ties by smaller id. Scores are
exact, and end at the limits of 64 bits. Further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftlens.llm.common import kept_aside

SCALE = 256
#: Each level cuts a segment into so many.
FAN = 4
#: Bytes of components in a block, and how many blocks there are at least where rows allow it.
BLOCK_BYTES = 32 << 20
LEAST_BLOCKS, LEAST_ROWS = 8, 1024
#: Products and sums below are exact in a float64.
EXACT = float(1 << 53)
END = (1 << 63) - 1

STORED = "row bigint, id bigint, label bigint, ints array<double>, copies bigint, summary array<double>"


def _levels(width: int) -> list[np.ndarray]:
    """Where the segments of every level start, coarse to fine; segments of one component tell no more."""
    counts, s = [], 1
    while s == 1 or 2 * s <= width:
        counts.append(s)
        s *= FAN
    return [np.arange(s) * width // s for s in counts] if width else []


def _summary(matrix: np.ndarray) -> np.ndarray:
    """Of every level: means times the root of the segment's length, then deviations."""
    parts = []
    for starts in _levels(matrix.shape[1]):
        sizes = np.diff(starts, append=matrix.shape[1])
        means = np.add.reduceat(matrix, starts, axis=1) / sizes
        rest = matrix - np.repeat(means, sizes, axis=1)
        parts += [means * np.sqrt(sizes), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))]
    return np.concatenate(parts, axis=1) if parts else np.zeros((len(matrix), 0))


def _matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    starts = np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths()))))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat[starts[rows][:, None] + np.arange(width)]


def stored(vectors: DataFrame, id: Column, label: Column, vector: Column) -> DataFrame:
    """Distinct usable rows with their number of copies and the summaries of their segments."""

    def whole(x: Column) -> Column:
        scaled = SCALE * x.cast("double")
        # beyond 2^53 every float64 is a whole number
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)

    rows = vectors.select(
        id.cast("bigint").alias("id"), label.cast("bigint").alias("label"), vector.alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    usable = rows.dropna().where(F.coalesce(finite, F.lit(False)))
    distinct = (
        usable.select("id", "label", F.transform("vector", whole).alias("ints"))
        .groupBy("id", "label", "ints")
        .agg(F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("row"), "id", "label", "ints", "copies")
    )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = batch.column("ints")
            lengths = np.asarray(ints.value_lengths())
            for width in np.unique(lengths):
                own = np.flatnonzero(lengths == width)
                found = _summary(_matrix(ints, own, width))
                at = pa.array(np.arange(len(own) + 1) * found.shape[1], pa.int32())
                summary = pa.ListArray.from_arrays(at, pa.array(found.ravel()))
                kept = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*kept.columns, summary], [*kept.schema.names, "summary"])

    return kept_aside(distinct.mapInArrow(summed, STORED))


class Block:
    """Vectors of one length with their summaries."""

    def __init__(self, table: pa.Table, rows: np.ndarray, width: int) -> None:
        of = lambda name: table.column(name).to_numpy()[rows]
        whole = lambda name: table.column(name).combine_chunks()
        self.row, self.id, self.label, self.copies = of("row"), of("id"), of("label"), of("copies")
        self.ints = _matrix(whole("ints"), rows, width)
        starts = _levels(width)
        self.summary = _matrix(whole("summary"), rows, 2 * sum(map(len, starts)))
        self.parts, at = [], 0
        for s in map(len, starts):
            self.parts.append((slice(at, at + s), slice(at + s, at + 2 * s)))
            at += 2 * s
        self.length = np.sqrt((self.ints * self.ints).sum(axis=1))
        self.largest = np.abs(self.ints).max(axis=1, initial=0)

    def bounds(self, level: int, asked: Block, a: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below and above the scores of ``rows`` with an anchor, by the summaries of a level."""
        means, rest = self.parts[level]
        middle = self.summary[rows, means] @ asked.summary[a, means]
        spread = self.summary[rows, rest] @ asked.summary[a, rest]
        # more than sums of so many float64 can be off by
        spread += 0.25 + 1e-13 * (self.ints.shape[1] + 8) * self.length[rows] * asked.length[a]
        return np.clip(middle - spread, -END, END), np.clip(middle + spread, -END, END)

    def scores(self, asked: Block, a: int, rows: np.ndarray) -> list[int]:
        vector, found = asked.ints[a], self.ints[rows]
        safe = self.largest[rows] * asked.largest[a] * max(1, len(vector)) < EXACT
        if safe.all():
            return (found @ vector).astype(np.int64).tolist()
        whole = [int(x) for x in vector]
        return [
            int(f @ vector) if s else max(-END - 1, min(END, sum(int(x) * y for x, y in zip(f, whole, strict=True))))
            for f, s in zip(found, safe, strict=True)
        ]


def _blocks(table: pa.Table) -> dict[int, Block]:
    lengths = np.asarray(table.column("ints").combine_chunks().value_lengths()) if len(table) else np.zeros(0)
    return {int(w): Block(table, np.flatnonzero(lengths == w), int(w)) for w in np.unique(lengths)}


def _first(ids: np.ndarray, scores: list[int], copies: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """The first ``k`` by score and id, copies one by one."""
    left = k
    for score, found, times in sorted(zip((-s for s in scores), ids.tolist(), copies.tolist(), strict=True)):
        for _ in range(min(times, left)):
            yield found, -score
        left -= times
        if left <= 0:
            return


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k]


def nearest(held: Block, asked: Block, a: int, k: int) -> Iterator[tuple[int, int]]:
    """Ids and scores of the anchor's first ``k`` others of its label."""
    copies = held.copies - (held.row == asked.row[a])
    alive = np.flatnonzero((held.label == asked.label[a]) & (copies > 0))
    floor = -math.inf
    for level in range(len(held.parts)):
        if len(alive) <= k:
            break
        low, high = held.bounds(level, asked, a, alive)
        floor = max(floor, _kth(low, k))
        alive = alive[high >= floor]
    yield from _first(held.id[alive], held.scores(asked, a, alive), copies[alive], k)


def within(
    held: Block, asked: Block, a: int, ranges: list[tuple[int, int]], k: int
) -> Iterator[tuple[int, int, int]]:
    """For each range of scores the first ``k`` of other labels in it: range, id, score."""
    alive = np.flatnonzero(held.label != asked.label[a])
    floors = [float(low) for low, _ in ranges]
    for level in range(len(held.parts)):
        low, high = held.bounds(level, asked, a, alive)
        stays = np.zeros(len(alive), bool)
        for i, (least, most) in enumerate(ranges):
            sure = low[(low >= least) & (high <= most)]
            if len(sure) >= k:
                floors[i] = max(floors[i], _kth(sure, k))
            stays |= (high >= floors[i]) & (low <= most)
        alive = alive[stays]
    scores = held.scores(asked, a, alive)
    for i, (least, most) in enumerate(ranges):
        inside = [j for j, s in enumerate(scores) if least <= s <= most]
        own = alive[inside]
        for found in _first(held.id[own], [scores[j] for j in inside], held.copies[own], k):
            yield (i, *found)


def _count(rows: DataFrame) -> int:
    """Blocks that keep ``BLOCK_BYTES``."""
    size, n = rows.agg(F.coalesce(F.sum(8 * F.size("ints")), F.lit(0)), F.count("*")).first()
    return max(1, math.ceil(size / BLOCK_BYTES), min(LEAST_BLOCKS, n // LEAST_ROWS))


def _paired(anchors: DataFrame, rows: DataFrame, search, schema: str) -> DataFrame:
    """``search(anchors, candidates)`` for every pair of blocks of the two frames."""
    n_anchors, n_rows = _count(anchors), _count(rows)
    dealt = lambda df, n: F.pmod(F.xxhash64("row"), F.lit(n)).alias("b")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1)))
    left = anchors.select("*", dealt(anchors, n_anchors).alias("a_block")).select("*", every(n_rows).alias("c_block"))
    right = rows.select("*", dealt(rows, n_rows).alias("c_block")).select("*", every(n_anchors).alias("a_block"))
    key = ["a_block", "c_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)


def _table(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table({n: pa.array(list(c), t) for (n, t), c in zip(schema.items(), columns, strict=True)})


def positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``row, positive_id, positive_score, place``; both frames come from ``stored``."""

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        blocks, out = _blocks(held), []
        for width, block in _blocks(asked).items():
            if width in blocks:
                for a, row in enumerate(block.row.tolist()):
                    out += [(row, *x) for x in nearest(blocks[width], block, a, k)]
        return _table(out, dict.fromkeys(["row", "positive_id", "positive_score"], pa.int64()))

    found = _paired(anchors, rows, search, "row bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def negatives(anchors: DataFrame, rows: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """``row, positive_score, rank, negative_id, negative_score``; anchors also have ``asked``, their
    different positive scores."""

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        blocks, out = _blocks(held), []
        wanted = dict(zip(asked.column("row").to_pylist(), asked.column("asked").to_pylist(), strict=True))
        for width, block in _blocks(asked).items():
            if width not in blocks:
                continue
            for a, row in enumerate(block.row.tolist()):
                ranges = [(p, -(-low * p // 100), high * p // 100) for p in sorted(wanted[row])]
                ranges = [x for x in ranges if x[1] <= x[2]]
                found = within(blocks[width], block, a, [x[1:] for x in ranges], k)
                out += [(row, ranges[i][0], *x) for i, *x in found]
        names = ["row", "positive_score", "negative_id", "negative_score"]
        return _table(out, dict.fromkeys(names, pa.int64()))

    schema = "row bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _paired(anchors, rows, search, schema)
    order = Window.partitionBy("row", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``rows`` are ``stored``."""
    anchors = rows.where(is_anchor)
    best = kept_aside(positives(anchors, rows, n_positives))
    scores = best.groupBy("row").agg(F.collect_set("positive_score").alias("asked"))
    worse = negatives(kept_aside(anchors.join(scores, "row")), rows, n_negatives, low, high)
    copies = anchors.select("row", F.col("id").alias("anchor_id"), F.explode(F.sequence(F.lit(1), "copies")))
    return (
        worse.join(best, ["row", "positive_score"])
        .join(copies, "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
