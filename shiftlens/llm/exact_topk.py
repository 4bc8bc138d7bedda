"""Exact top-k by inner product without random access.

Vectors are turned into integers. A task takes its vectors in blocks and sorts every component of a
block once, which gives one sorted list per component. A query reads all lists together, from the
end that its own sign prefers, a stretch at a time; queries that stand at the same stretch read together. What has been read of a vector gives a lower
and an upper bound of its score: unread components are bounded by where their lists stand and
where they end. Vectors whose upper bound is below the k-th lower bound are given up; reading stops
when no vector outside the remaining few, seen or unseen, can still qualify, and those few are
resolved exactly. A task carries its k-th score from block to block, and hands over at most k rows
for each query.

The queries reach the tasks in batches of bounded size; each batch is one pass over the vectors.
A k-th place is shared out to the smaller id. Vectors that are null or hold null or non-finite
components, or whose id is null, take no part. A query never meets its own row; every other row is a
candidate, also one of the same id or an equal one. Rows that share an id are queries of their own. Vectors of
another length than the query's are not compared with it. Products are exact as long as sums of them stay below
2^53, which components of up to 2^23 in vectors of up to 128 do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftlens.llm.common import kept_aside

SCALE = 256
#: Vectors sorted together.
BLOCK = 4096
#: Bytes of query components that go with one pass over the vectors.
QUERY_BYTES = 16 << 20
#: Queries that read a block's lists together.
TOGETHER = 128
#: So many stretches make a list; and the few left are resolved once they are so small a share.
STRETCH = 4

FOUND = "row bigint, vec_id bigint, score bigint"


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, ints``: floor(256 x) of every component, where all of them are finite."""
    whole = F.transform(F.col(vector), lambda x: F.floor(SCALE * x.cast("double")))
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.where(usable).select(F.col(key).cast("bigint").alias("vec_id"), whole.alias("ints"))


def rows_of(vectors: DataFrame, k: int) -> DataFrame:
    """``row, vec_id, ints, copies``: equal rows once, as often as a result of ``k`` can hold them.

    Only the first of them has its ``row``, which is what a query leaves out; the others have -1.
    """
    distinct = vectors.groupBy("vec_id", "ints").agg(F.count("*").alias("copies"))
    held = kept_aside(distinct.select(F.monotonically_increasing_id().alias("row"), "*"))
    every = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k + 1)).cast("int")))
    row = F.when(F.col("copy") == 1, F.col("row")).otherwise(F.lit(-1)).alias("row")
    return held.select("*", every.alias("copy")).select(row, "vec_id", "ints", "copies")


class Lists:
    """The sorted lists of one block of vectors, readable from either end."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        self.own, self.ids, self.block = rows, ids, block
        n, width = block.shape
        up = np.argsort(block, axis=0, kind="stable")
        values = np.take_along_axis(block, up, axis=0)
        places = np.empty((n, width), np.int32)
        np.put_along_axis(places, up, np.arange(n, dtype=np.int32)[:, None], axis=0)
        #: A component's place in its list, and the list, from the largest down and from the least up.
        self.lists = (n - 1 - places, values[::-1]), (places, values)

    def _bounds(self, read: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest products' components after ``read`` places of every list, for both signs.

        Components that were read stand for themselves; unread ones lie between the end of their
        list and where reading stands.
        """
        ends = [np.where(places < read, self.block, values[-1]) for places, values in self.lists]
        here = [np.where(places < read, self.block, values[read - 1]) for places, values in self.lists]
        return np.hstack(ends), np.hstack(here)

    def best(self, query_rows: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple]:
        """For every query ids and scores of the block's k best that reach its floor, a k-th score found before."""
        n = len(self.block)
        # a list is read from the end that the query's sign prefers
        signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
        alive = self.own[None, :] != query_rows[:, None]
        floors, reading = floors.copy(), np.arange(len(queries))
        step = -(-n // STRETCH)
        for read in range(step, n, step):
            low, high = self._bounds(read)
            lower = np.where(alive[reading], signed[reading] @ low.T, -np.inf)
            if n > k:
                kth = np.partition(lower, n - k, axis=1)[:, n - k]
                floors[reading] = np.maximum(floors[reading], kth)
            alive[reading] &= signed[reading] @ high.T >= floors[reading, None]
            reading = reading[alive[reading].sum(axis=1) * STRETCH > n]
            if not len(reading):
                break
        found = []
        for query, here in zip(queries, alive, strict=True):
            left = np.flatnonzero(here)
            scores = (self.block[left] @ query).astype(np.int64)
            first = np.lexsort((self.ids[left], -scores))[:k]
            found.append((self.ids[left][first], scores[first]))
        return found


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, ids and components, apart by length."""
    column = batch.column("ints")
    rows = batch.column("row").to_numpy(zero_copy_only=False)
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    for width in np.unique(lengths):
        own = np.flatnonzero(lengths == width)
        yield rows[own], ids[own], flat[starts[own][:, None] + np.arange(width)]


def _pass(vectors: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for rows, ids, matrix in _matrix(batch):
                asked = shared.value.get(matrix.shape[1])
                for at in range(0, len(ids) if asked else 0, BLOCK):
                    part = slice(at, at + BLOCK)
                    lists = Lists(rows[part], ids[part], matrix[part])
                    for together in range(0, len(asked[0]), TOGETHER):
                        query_rows, queries = (x[together : together + TOGETHER] for x in asked)
                        held = [best.get(q, none) for q in query_rows.tolist()]
                        floors = [h[1][-1] if len(h[1]) == k else -np.inf for h in held]
                        found = lists.best(query_rows, queries, k, np.array(floors, np.float64))
                        for q, have, new in zip(query_rows.tolist(), held, found, strict=True):
                            if len(new[0]):
                                both = [np.concatenate(x) for x in zip(have, new, strict=True)]
                                first = np.lexsort((both[0], -both[1]))[:k]
                                best[q] = both[0][first], both[1][first]
        for query_row, (ids, scores) in best.items():
            asked_by = np.full(len(ids), query_row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (asked_by, ids, scores)],
                ["row", "vec_id", "score"],
            )

    return vectors.mapInArrow(search, FOUND)


def _batches(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Query batches of at most ``QUERY_BYTES``, one at a time on the driver."""
    held: dict[int, tuple[list, list]] = {}
    size = 0
    for row in queries.toLocalIterator():
        ids, vectors = held.setdefault(len(row["ints"]), ([], []))
        ids.append(row["row"])
        vectors.append(row["ints"])
        size += 8 * len(row["ints"])
        if size >= QUERY_BYTES:
            yield {w: (np.array(i), np.array(v, np.float64)) for w, (i, v) in held.items()}
            held, size = {}, 0
    yield {w: (np.array(i), np.array(v, np.float64)) for w, (i, v) in held.items()}


def top_k(rows: DataFrame, asks: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best for every row that ``asks``.

    ``rows`` comes from ``rows_of`` with the same ``k``.
    """
    queries = rows.where((F.col("row") >= 0) & asks)
    passes = _batches(queries)
    found = _pass(rows, next(passes), k)
    more = [kept_aside(_pass(rows, batch, k)) for batch in passes]
    for other in more:
        found = found.unionByName(other)
    # a task hands over at most k rows a query, so what meets here is small
    by_score = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    # equal queries have equal results
    every = F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))
    asked = queries.select("row", F.col("vec_id").alias("query_id"), every.alias("copy"))
    return ranked.join(asked, "row").select("query_id", "rank", "vec_id", "score")
