"""Cohorts of the base view: profiles, two-cohort comparison, period and volume shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from shiftlens.catalog import (
    DIMENSIONS,
    MIN_SAMPLE,
    SCORE_COLUMNS,
    Dimension,
    dimension,
)
from shiftlens.functions.numeric import indicator, ratio
from shiftlens.operators.significance import two_proportion_p, two_proportion_z


def base_view(loans: DataFrame, scores: DataFrame) -> DataFrame:
    """Facts with their score; both sides are unique on ``user_id``."""
    return loans.join(scores.select("user_id", *SCORE_COLUMNS), "user_id", "inner")


def predicate(expression: str | None) -> Column:
    """A cohort expression as a column; blank means everyone."""
    return F.expr(expression) if expression and expression.strip() else F.lit(True)


def cohort(view: DataFrame, expression: str | None) -> DataFrame:
    return view.where(predicate(expression))


def member(expression: str | None) -> Column:
    """Cohort membership as a plain boolean (unknown counts as outside)."""
    return F.coalesce(predicate(expression), F.lit(False))


def compared(base: str | None) -> Column:
    """Membership of the base; without one the target stands alone and nobody is in it."""
    return member(base) if base and base.strip() else F.lit(False)


def _dimension(dim: str | Column) -> Dimension:
    return dimension(dim) if isinstance(dim, str) else Dimension(lambda: dim, lambda: F.lit(0))


def segment_profile(view: DataFrame, dim: str | Column, target: str | None = None) -> DataFrame:
    """``segment, seg_ord, n, share, bad_rate, avg_score`` and the cohort's overall rate."""
    chosen = _dimension(dim)
    groups = (
        cohort(view, target)
        .groupBy(chosen.label().alias("segment"), chosen.rank().alias("seg_ord"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("is_bad").alias("bad"),
            F.avg("is_bad").alias("bad_rate"),
            F.avg("risk_score").alias("avg_score"),
        )
    )
    # one row per segment from here on
    everyone = Window.partitionBy()
    return groups.select(
        "segment",
        "seg_ord",
        "n",
        ratio(F.col("n"), F.sum("n").over(everyone)).alias("share"),
        "bad_rate",
        "avg_score",
        ratio(F.sum("bad").over(everyone), F.sum("n").over(everyone)).alias("overall_rate"),
    ).orderBy("seg_ord", "segment")


def profile_all(
    view: DataFrame, target: str | None = None, dims: list[str] | None = None
) -> DataFrame:
    """``segment_profile`` for many dimensions with one scan of the view."""
    names = dims or list(DIMENSIONS)
    cuts = F.array(
        *[
            F.struct(
                F.lit(name).alias("dimension"),
                DIMENSIONS[name].label().cast("string").alias("segment"),
                DIMENSIONS[name].rank().alias("seg_ord"),
            )
            for name in names
        ]
    )
    rows = cohort(view, target).select("is_bad", "risk_score", F.inline(cuts))
    groups = rows.groupBy("dimension", "segment", "seg_ord").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("is_bad").alias("bad_rate"),
        F.avg("risk_score").alias("avg_score"),
    )
    per_dim = Window.partitionBy("dimension")
    return groups.withColumn("share", ratio(F.col("n"), F.sum("n").over(per_dim)))


def _two_cohorts(view: DataFrame, dim: str | Column, target: str, base: str | None) -> DataFrame:
    """Counts and rates of both cohorts per segment from one scan; cohorts may overlap."""
    chosen = _dimension(dim)
    flagged = view.select(
        chosen.label().alias("segment"),
        chosen.rank().alias("seg_ord"),
        "is_bad",
        compared(base).alias("in_base"),
        member(target).alias("in_target"),
    ).where("in_base OR in_target")
    sides = []
    for side in ("base", "target"):
        inside = F.col(f"in_{side}")
        sides += [
            F.count_if(inside).alias(f"n_{side}"),
            F.coalesce(F.sum(F.when(inside, F.col("is_bad"))), F.lit(0)).alias(f"bad_{side}"),
            F.avg(F.when(inside, F.col("is_bad"))).alias(f"rate_{side}"),
        ]
    groups = flagged.groupBy("segment", "seg_ord").agg(*sides)
    everyone = Window.partitionBy()
    for side in ("base", "target"):
        groups = groups.withColumn(f"all_{side}", F.sum(f"n_{side}").over(everyone))
    return groups.where(F.col("all_target") > 0)


def segment_compare(
    view: DataFrame, dim: str | Column, target: str, base: str | None = None
) -> DataFrame:
    """Mix and rate effect per segment; without ``base`` the target's profile.

    A segment that one cohort lacks counts 0 there. An empty base leaves its shares, rates and
    effects null; an empty target gives no rows.
    """
    if not (base and base.strip()):
        return segment_profile(view, dim, target)
    return _segment_effects(view, dim, target, base)


def _segment_effects(
    view: DataFrame, dim: str | Column, target: str, base: str | None
) -> DataFrame:
    groups = _two_cohorts(view, dim, target, base)

    def rate(side: str) -> Column:
        return F.when(F.col(f"all_{side}") > 0, F.coalesce(F.col(f"rate_{side}"), F.lit(0.0)))

    out = groups.select(
        "segment",
        "seg_ord",
        "n_base",
        ratio(F.col("n_base"), F.col("all_base")).alias("share_base"),
        rate("base").alias("bad_rate_base"),
        "n_target",
        ratio(F.col("n_target"), F.col("all_target")).alias("share_target"),
        rate("target").alias("bad_rate_target"),
        "bad_base",
        "bad_target",
    )
    share_shift = F.col("share_target") - F.col("share_base")
    rate_shift = F.col("bad_rate_target") - F.col("bad_rate_base")
    return (
        out.withColumn("mix_effect", share_shift * F.col("bad_rate_base"))
        .withColumn("rate_effect", F.col("share_target") * rate_shift)
        .orderBy("seg_ord", "segment")
    )


def compare_summary(
    view: DataFrame, dim: str | Column, target: str, base: str | None = None
) -> DataFrame:
    """One row: both sizes and rates, their difference, its p-value and the summed effects.

    Without ``base`` all that needs one is null.
    """
    totals = _segment_effects(view, dim, target, base).agg(
        *[
            F.sum(c).alias(c)
            for c in (
                "n_base",
                "bad_base",
                "n_target",
                "bad_target",
                "mix_effect",
                "rate_effect",
            )
        ]
    )
    sides = [F.col(c) for c in ("bad_target", "n_target", "bad_base", "n_base")]
    rated = (
        totals.where(F.col("n_target") > 0)
        .withColumn("rate_base", ratio(F.col("bad_base"), F.col("n_base")))
        .withColumn("rate_target", ratio(F.col("bad_target"), F.col("n_target")))
        .withColumn("diff", F.col("rate_target") - F.col("rate_base"))
    )
    return rated.select(
        "n_base",
        "rate_base",
        "n_target",
        "rate_target",
        "diff",
        two_proportion_z(*sides).alias("z"),
        two_proportion_p(*sides).alias("p_value"),
        "mix_effect",
        "rate_effect",
        ratio(F.col("mix_effect"), F.col("diff")).alias("mix_pct"),
    )


def cohort_rate(view: DataFrame, target: str | None = None) -> DataFrame:
    """Count and rate of one cohort."""
    return cohort(view, target).agg(
        F.count(F.lit(1)).alias("n"), F.avg("is_bad").alias("bad_rate")
    )


def cohort_rates(view: DataFrame, cohorts: dict[str, str | None]) -> DataFrame:
    """Count and rate of many named cohorts with one scan."""
    held = F.filter(
        F.array(*[F.when(member(e), F.lit(name)) for name, e in cohorts.items()]),
        lambda x: x.isNotNull(),
    )
    counted = (
        view.select("is_bad", F.explode(held).alias("cohort"))
        .groupBy("cohort")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("is_bad").alias("bad_rate"))
    )
    return counted


def indicator_rates(view: DataFrame, indicators: dict[str, Column]) -> DataFrame:
    """Average of several conditions, one column each."""
    return view.agg(*[F.avg(indicator(c)).alias(name) for name, c in indicators.items()])


def rate_by(view: DataFrame, *keys: str) -> DataFrame:
    """Count and rate per key combination."""
    return view.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("is_bad").alias("bad_rate")
    )


def rate_matrix(
    view: DataFrame, rows: str, columns: str, values: list | None = None, decimals: int = 3
) -> DataFrame:
    """Rates laid out as rows × columns; pass the column values to save the pass that lists them."""
    rate = F.round(F.avg("is_bad"), decimals)
    return view.groupBy(rows).pivot(columns, values).agg(rate)


def volume_matrix(
    view: DataFrame, rows: str, columns: str, values: list | None = None
) -> DataFrame:
    return view.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1)))


def _against_others(groups: DataFrame, by: str) -> DataFrame:
    """Add what the other rows of the same ``by`` hold (groups are already counted)."""
    same = Window.partitionBy(by)
    return groups.select(
        "*",
        (F.sum("n").over(same) - F.col("n")).alias("n_others"),
        (F.sum("bad").over(same) - F.col("bad")).alias("bad_others"),
        (F.count(F.lit(1)).over(same) - 1).alias("periods_others"),
    )


def anomaly_scan(
    view: DataFrame, by: str = "channel", period: str = "loan_month", alpha: float = 0.05
) -> DataFrame:
    """Each (by, period) against the other periods of the same ``by``.

    ``flag`` is ``up`` or ``down`` when the difference is significant and the group is not too
    small, else ``none``.
    """
    groups = view.groupBy(by, period).agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_bad").alias("bad")
    )
    sides = [F.col(c) for c in ("bad", "n", "bad_others", "n_others")]
    scored = _against_others(groups, by).select(
        by,
        period,
        "n",
        ratio(F.col("bad"), F.col("n")).alias("bad_rate"),
        ratio(F.col("bad_others"), F.col("n_others")).alias("rate_others"),
        two_proportion_z(*sides).alias("z"),
        two_proportion_p(*sides).alias("p_value"),
    )
    clear = (F.col("p_value") < alpha) & (F.col("n") >= MIN_SAMPLE)
    return scored.withColumn("diff", F.col("bad_rate") - F.col("rate_others")).withColumn(
        "flag",
        F.when(clear & (F.col("diff") > 0), "up")
        .when(clear & (F.col("diff") < 0), "down")
        .otherwise("none"),
    )


def volume_anomaly(view: DataFrame, by: str = "channel", period: str = "loan_month") -> DataFrame:
    """Count of each (by, period) over the mean count of the other periods of the same ``by``."""
    groups = view.groupBy(by, period).agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_bad").alias("bad")
    )
    others = ratio(F.col("n_others"), F.col("periods_others"))
    return _against_others(groups, by).select(
        by,
        period,
        "n",
        others.alias("mean_others"),
        (F.col("n") / others).alias("volume_ratio"),
    )


def period_delta(view: DataFrame, period: str, by: str | None = None) -> DataFrame:
    """Rate inside a period minus the rate outside it, overall or per ``by``."""
    inside = view.withColumn("__in", member(period))
    keys = [by] if by else []
    return (
        inside.groupBy(*keys)
        .agg(
            F.count_if("__in").alias("n_in"),
            F.count_if(~F.col("__in")).alias("n_out"),
            F.avg(F.when(F.col("__in"), F.col("is_bad"))).alias("rate_in"),
            F.avg(F.when(~F.col("__in"), F.col("is_bad"))).alias("rate_out"),
        )
        .withColumn("delta", F.col("rate_in") - F.col("rate_out"))
    )


def weighted_vs_simple_rate(view: DataFrame, by: str) -> DataFrame:
    """The rate over all rows beside the mean of the group rates."""
    groups = view.groupBy(by).agg(
        F.count("is_bad").alias("n"), F.sum("is_bad").alias("bad"), F.avg("is_bad").alias("rate")
    )
    return groups.agg(
        ratio(F.sum("bad"), F.sum("n")).alias("weighted_rate"),
        F.avg("rate").alias("simple_rate"),
        F.count(F.lit(1)).alias("n_groups"),
    ).withColumn("gap", F.col("simple_rate") - F.col("weighted_rate"))


def share_shift(
    view: DataFrame, part: str, target: str, base: str | None = None
) -> DataFrame:
    """Share of a sub-cohort within the base and the target; without ``base`` of the target alone."""
    flags = view.select(
        member(part).alias("p"), compared(base).alias("b"), member(target).alias("t")
    )
    return flags.agg(
        F.avg(F.when(F.col("b"), indicator(F.col("p")))).alias("share_base"),
        F.avg(F.when(F.col("t"), indicator(F.col("p")))).alias("share_target"),
    ).withColumn("shift", F.col("share_target") - F.col("share_base"))


def extreme_segment(view: DataFrame, dim: str | Column) -> DataFrame:
    """Segments with the highest and the lowest rate (ties by label)."""
    groups = view.groupBy(_dimension(dim).label().alias("segment")).agg(
        F.avg("is_bad").alias("bad_rate")
    )
    high = F.struct((-F.col("bad_rate")).alias("o"), F.col("segment"))
    low = F.struct(F.col("bad_rate").alias("o"), F.col("segment"))
    return groups.agg(
        F.min(high).alias("h"), F.min(low).alias("l")
    ).select(
        F.col("h.segment").alias("worst_segment"),
        (-F.col("h.o")).alias("worst_rate"),
        F.col("l.segment").alias("best_segment"),
        F.col("l.o").alias("best_rate"),
    )
