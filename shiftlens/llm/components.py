"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftlens.llm.common import kept_aside


#: Edges of one vertex that a task takes together.
TOGETHER = 100_000


def _key(vertex):
    return tuple(vertex.values()) if isinstance(vertex, dict) else vertex


def contracted(edges: DataFrame, by: str) -> DataFrame:
    """``a, b`` with the same components, dealt by their smaller end ``a`` or their larger one ``b``.

    A task joins what its edges connect and hands over a star for each component: an edge from its
    smallest vertex to every other, or a loop where there is none.
    """
    schema = edges.select("a", "b").schema

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, named = {}, {}

        def top(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                ends = _key(a), _key(b)
                for key, vertex in zip(ends, (a, b), strict=True):
                    if key not in above:
                        above[key], named[key] = key, vertex
                first, second = sorted(map(top, ends))
                above[second] = first
        if kind is not None:
            pairs = [(top(x), x) for x in above]
            wide = {r for r, x in pairs if r != x}
            kept = [(r, x) for r, x in pairs if r != x or x not in wide]
            columns = [pa.array([named[p[i]] for p in kept], kind.field(i).type) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    other = "b" if by == "a" else "a"
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ends = kept_aside(ends.distinct())
    # a vertex with very many edges is dealt out to several tasks
    many = ends.groupBy(F.col(by).alias("hub")).agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    hubs = kept_aside(many.where("parts > 1"))
    part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)))
    dealt = ends.join(hubs, ends[by] == hubs["hub"], "left").select("a", "b", part.alias("part"))
    return dealt.repartition(by, "part").select("a", "b").mapInArrow(stars, schema)


def components(edges: DataFrame) -> DataFrame:
    """``vertex, label``: the smallest vertex of each one's component; edges are ``a, b``.

    Edges are contracted by one end and then by the other, after which a vertex has an edge to the smallest
    of its component in a task, whatever the number of edges that a group came with. Every round then takes the smallest label among neighbours and then the label of that label, so the
    distance covered doubles; it ends when no label changes. Each round is a written table. Empty
    edges give no rows; loops and repeated edges change nothing.
    """
    edges = kept_aside(contracted(kept_aside(contracted(edges, "a")), "b"))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = kept_aside(both.distinct())
    labels = kept_aside(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("vertex"), F.least("a", "m").alias("label")
    ))
    while True:
        near = both.join(labels, both["b"] == labels["vertex"]).select(F.col("a").alias("vertex"), "label")
        least = kept_aside(near.union(labels).groupBy("vertex").agg(F.min("label").alias("label")))
        above = least.select(F.col("vertex").alias("label"), F.col("label").alias("higher"))
        jumped = least.join(above, "label").select("vertex", F.col("higher").alias("label"))
        moved = kept_aside(jumped)
        old = labels.select("vertex", F.col("label").alias("was"))
        if moved.join(old, "vertex").where(F.col("was") != F.col("label")).isEmpty():
            return moved
        labels = moved
