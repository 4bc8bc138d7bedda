"""Two-proportion and contingency tests as column expressions over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions.numeric import chi_square_p, ratio, two_sided_p


def two_proportion_z(bad_1: Column, n_1: Column, bad_2: Column, n_2: Column) -> Column:
    """Pooled z of rate 1 against rate 2; null when a side is empty or the pooled rate is 0 or 1."""
    pooled = ratio(bad_1 + bad_2, n_1 + n_2)
    spread = pooled * (F.lit(1.0) - pooled) * (ratio(F.lit(1), n_1) + ratio(F.lit(1), n_2))
    z = (ratio(bad_1, n_1) - ratio(bad_2, n_2)) / F.sqrt(spread)
    return F.when((n_1 > 0) & (n_2 > 0) & (spread > 0), z)


def two_proportion_p(bad_1: Column, n_1: Column, bad_2: Column, n_2: Column) -> Column:
    return two_sided_p(two_proportion_z(bad_1, n_1, bad_2, n_2))


def contingency_table(df: DataFrame, group: Column, label: str = "is_bad") -> DataFrame:
    """Bad and good counts per group."""
    return df.groupBy(group.alias("segment")).agg(
        F.sum(label).cast("bigint").alias("bad"),
        (F.count(label) - F.sum(label)).cast("bigint").alias("good"),
    )


def chi_square_independence(df: DataFrame, group: Column, label: str = "is_bad") -> DataFrame:
    """Pearson test of label against group: one row ``statistic, dof, p_value``.

    With one degree of freedom each deviation is shrunk by up to 0.5 (Yates). Null when a label
    or all but one group is missing.
    """
    table = contingency_table(df, group, label)
    sums = F.sum(F.col("bad")).alias("b"), F.sum(F.col("good")).alias("g")
    cells = table.withColumn("all", table.agg(F.struct(*sums, F.count("*").alias("k"))).scalar())
    size, b, g = F.col("bad") + F.col("good"), F.col("all.b"), F.col("all.g")
    dof = (F.col("all.k") - 1).cast("int")

    def part(seen: Column, margin: Column) -> Column:
        expected = size * margin / (b + g).cast("double")
        gap = F.abs(seen - expected)
        gap = F.when(dof == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
        return gap * gap / F.nullif(expected, F.lit(0.0))

    usable = (b > 0) & (g > 0) & (dof > 0)
    total = cells.agg(
        F.sum(F.when(usable, part(F.col("bad"), b) + part(F.col("good"), g))).alias("statistic"),
        F.max(dof).alias("dof"),
    )
    return total.withColumn("p_value", chi_square_p(F.col("statistic"), F.col("dof")))
