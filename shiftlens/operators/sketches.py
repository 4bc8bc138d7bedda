"""Stored sketches that merge: score quantiles and shifts of any months, overlaps of any cohorts.

A row per (month, segment) holds a quantile sketch of the scores and a set sketch of the users. What is asked
of a range of months or of several cohorts is merged from these rows, without touching users again.

Bounds: with ``QUANTILE_K`` a rank is off by less than ``RANK_BOUND`` (99 % of all sketches), and with 2^``SET_BITS``
entries the count of a union is off by less than ``SET_BOUND`` (three standard errors); up to that many users
it is exact. An intersection or difference is off by that share of the union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftlens.catalog import PSI_FLOOR
from shiftlens.functions.numeric import ratio
from shiftlens.operators.monitor import psi_label

QUANTILE_K = 800
RANK_BOUND = 0.005
SET_BITS = 14
SET_BOUND = 3 / 2 ** (SET_BITS / 2)


def sketched(
    view: DataFrame, by: list[str], score: str = "risk_score", user: str = "user_id"
) -> DataFrame:
    """``by..., scores, users``: the rows that all else is merged from."""
    return view.groupBy(*by).agg(
        F.kll_sketch_agg_double(F.col(score).cast("double"), F.lit(QUANTILE_K)).alias("scores"),
        F.theta_sketch_agg(F.col(user), F.lit(SET_BITS)).alias("users"),
    )


def score_quantiles(rows: DataFrame, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """``by..., n, quantiles`` of the merged rows."""
    merged = rows.groupBy(*(by or [])).agg(F.kll_merge_agg_double("scores").alias("s"))
    n = F.kll_sketch_get_n_double("s")
    found = F.array(*[F.kll_sketch_get_quantile_double("s", F.lit(float(p))) for p in probs])
    return merged.where(n > 0).select(*(by or []), n.alias("n"), found.alias("quantiles"))


def psi(rows: DataFrame, target: Column, base: Column, bins: int = 10) -> DataFrame:
    """Stability index of the rows of ``target`` against those of ``base``: one row.

    The edges are quantiles of the merged base, the shares come from both merged sketches.
    """
    merged = rows.agg(
        F.kll_merge_agg_double(F.when(target, F.col("scores"))).alias("t"),
        F.kll_merge_agg_double(F.when(base, F.col("scores"))).alias("b"),
    ).where((F.kll_sketch_get_n_double("t") > 0) & (F.kll_sketch_get_n_double("b") > 0))
    inner = [F.kll_sketch_get_quantile_double("b", F.lit(i / bins)) for i in range(1, bins)]
    # a sketch is asked for the rank of given numbers, so these few come back first
    known = merged.select(F.array_sort(F.array_distinct(F.array(*inner))).alias("e")).first()
    edges = [*(known["e"] if known else []), float("inf")]
    ranks = F.array(
        *[
            F.struct(
                F.lit(e).alias("edge"),
                *[F.kll_sketch_get_rank_double(c, F.lit(e)).alias(c) for c in ("t", "b")],
            )
            for e in edges
        ]
    )
    upto = merged.select(F.inline(ranks))
    order = Window.orderBy("edge")  # one row for each edge
    shares = upto.select(
        *[
            F.greatest(F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0.0)), F.lit(PSI_FLOOR)).alias(c)
            for c in ("t", "b")
        ]
    )
    found = shares.agg(F.sum((F.col("t") - F.col("b")) * F.log(F.col("t") / F.col("b"))).alias("psi"))
    return found.select("psi", F.when(F.col("psi").isNotNull(), psi_label(F.col("psi"))).alias("shift"))


def overlap(rows: DataFrame, left: Column, right: Column) -> DataFrame:
    """One row: estimated users of both cohorts, in common, in either, and in the left one alone."""
    merged = rows.agg(
        F.theta_union_agg(F.when(left, F.col("users")), F.lit(SET_BITS)).alias("l"),
        F.theta_union_agg(F.when(right, F.col("users")), F.lit(SET_BITS)).alias("r"),
    )
    count = F.theta_sketch_estimate
    return merged.select(
        count("l").alias("n_left"),
        count("r").alias("n_right"),
        count(F.theta_intersection("l", "r")).alias("n_both"),
        count(F.theta_union("l", "r", F.lit(SET_BITS))).alias("n_either"),
        count(F.theta_difference("l", "r")).alias("n_left_only"),
    ).withColumn("jaccard", ratio(F.col("n_both"), F.col("n_either")))
