"""Ranks, running totals and exact quantiles over orders too long for one task.

A window without a partition key (or with a hot one) puts all its rows into one task. Here the
order is cut up by a range exchange, each stretch is totalled on its own, and the small table of
totals per stretch supplies what came before. Results are exact; only the bounds are approximate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from shiftlens.sources.tables import stored


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on keys where null meets null; the right side's keys are dropped."""
    other = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, condition, how).drop(*[f"__{k}" for k in keys])


def position(value: Column, bounds: Column, most: Column | int) -> Column:
    """How many of the sorted bounds (``most`` at most) are <= value, by halving steps."""
    if isinstance(most, int):
        steps = F.lit([1 << i for i in reversed(range(most.bit_length()))])
    else:
        bits = F.greatest(F.ceil(F.log2(most + 1)), F.lit(1)).cast("int")
        steps = F.transform(
            F.sequence(bits - 1, F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int")
        )

    def advance(at: Column, step: Column) -> Column:
        reached = at + step
        fits = (reached <= F.size(bounds)) & (F.get(bounds, reached - 1) <= value)
        return at + F.when(F.coalesce(fits, F.lit(False)), step).otherwise(0)

    return F.aggregate(steps, F.lit(0), advance)


def _cut_up(df: DataFrame, sort: list[Column]) -> DataFrame:
    """The rows with the number of their stretch of the order, written once.

    Stretches are the partitions of a range exchange, so their number follows the session's shuffle
    partitions and their bounds the data.
    """
    return stored(df.repartitionByRange(*sort).withColumn("__cut", F.spark_partition_id()))


def _before(cut: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key group and stretch the sums of all earlier stretches, and those of the group."""
    earlier = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return cut.groupBy(*keys, "__cut").agg(*[F.sum(v).alias(f"__{v}") for v in values]).select(
        *keys,
        "__cut",
        *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}_off") for v in values],
        *[F.sum(f"__{v}").over(whole).alias(f"{v}_total") for v in values],
    )


def running_totals(
    df: DataFrame, keys: list[str], order: str, values: list[str], descending: bool = False
) -> DataFrame:
    """Add ``<v>_before`` and ``<v>_total`` per key group for every value column.

    ``df`` holds one row per (keys, order); collapse equal order values first, so that no stretch
    can be made of one value.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    cut = _cut_up(df, [*map(F.col, keys), by])
    inside = Window.partitionBy(*keys, "__cut").orderBy(by).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = cut.select(
        "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__{v}_in") for v in values]
    )
    joined = null_safe_join(local, _before(cut, keys, values), keys + ["__cut"])
    return joined.select(
        *df.columns,
        *[(F.col(f"__{v}_off") + F.col(f"__{v}_in")).alias(f"{v}_before") for v in values],
        *[f"{v}_total" for v in values],
    )


def global_rank(
    df: DataFrame, keys: list[str], score: str, tie: str, rank: str = "rank"
) -> DataFrame:
    """Rank from 1 by descending score, ties by ascending ``tie``, without one task per key group.

    Equal scores (say all the zeros) are cut up along the tie column.
    """
    sort = [F.col(score).desc(), F.col(tie).asc()]
    cut = _cut_up(df, [*map(F.col, keys), *sort]).withColumn("__n", F.lit(1))
    place = F.row_number().over(Window.partitionBy(*keys, "__cut").orderBy(*sort))
    ranked = null_safe_join(
        cut.withColumn("__place", place), _before(cut, keys, ["__n"]), keys + ["__cut"]
    )
    return ranked.select(
        *df.columns, (F.col("____n_off") + F.col("__place")).cast("bigint").alias(rank)
    )


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with their number from 0 in the order of ``by``, which should tell all rows apart."""
    cut = _cut_up(df, [F.col(c).asc() for c in by])
    place = F.row_number().over(Window.partitionBy("__cut").orderBy(*by))
    before = _before(cut.select("__cut", F.lit(1).alias("__n")), [], ["__n"])
    placed = null_safe_join(cut.withColumn("__place", place), before, ["__cut"])
    return placed.select(
        (F.col("____n_off") + F.col("__place") - 1).cast("bigint").alias(name), *df.columns
    )


def exact_quantiles(
    counts: DataFrame,
    value: str,
    weight: str,
    probs: list[float],
    keys: list[str] | None = None,
) -> DataFrame:
    """``quantiles array<double>`` per key, linearly interpolated, from (value, weight) rows."""
    keys = keys or []
    known = counts.where(F.col(value).isNotNull())
    run = running_totals(known, keys, value, [weight])
    upto = F.col(f"{weight}_before") + F.col(weight)
    picks = []
    for i, p in enumerate(probs):
        at = (F.col(f"{weight}_total") - 1) * F.lit(float(p))
        picks += [
            F.min(F.when(upto > F.floor(at), F.col(value))).alias(f"__lo{i}"),
            F.min(F.when(upto > F.ceil(at), F.col(value))).alias(f"__hi{i}"),
            F.max(at - F.floor(at)).alias(f"__fr{i}"),
        ]
    row = run.where(F.col(weight) > 0).groupBy(*keys).agg(*picks)
    return row.select(
        *keys,
        F.array(
            *[
                F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__fr{i}")
                for i in range(len(probs))
            ]
        ).alias("quantiles"),
    )
