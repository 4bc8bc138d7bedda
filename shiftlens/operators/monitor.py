"""Score monitoring: summaries, stability index, ranking power, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from shiftlens.catalog import LEVEL_HIGH, LEVEL_MID, PSI_FLOOR, PSI_LARGE, PSI_SLIGHT, RISK_LEVELS
from shiftlens.functions.numeric import indicator, ratio
from shiftlens.operators.cohort import cohort, compared, member
from shiftlens.operators.ordering import exact_quantiles, running_totals
from shiftlens.sources.tables import stored

STORED_DECIMALS = 4  # fixed value: how scores are stored; for an explicit ``decimals``


def risk_level(score: Column) -> Column:
    """Band of an unrounded score."""
    high, mid, low = RISK_LEVELS
    return F.when(score >= LEVEL_HIGH, high).when(score >= LEVEL_MID, mid).otherwise(low)


def score_summary(view: DataFrame, target: str | None, base: str | None = None) -> DataFrame:
    """Size, mean score, mean label and level shares; base row first. One scan for both cohorts.

    Without a base, or with a blank one, there is the target's row alone.
    """
    cohorts = [("base", base)] if base and base.strip() else []
    cohorts.append(("target", target))
    flags = [member(e).alias(f"in_{name}") for name, e in cohorts]
    needed = view.select("risk_score", "risk_level", "is_bad", *flags)
    aggregates = []
    for name, _ in cohorts:
        inside = F.col(f"in_{name}")

        def mean(c: Column) -> Column:
            return F.avg(F.when(inside, c))

        aggregates += [
            F.count_if(inside).alias(f"{name}_n"),
            mean(F.col("risk_score")).alias(f"{name}_score"),
            mean(F.col("is_bad")).alias(f"{name}_rate"),
            *[
                mean(indicator(F.col("risk_level") == level)).alias(f"{name}_level{i}")
                for i, level in enumerate(RISK_LEVELS)
            ],
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(name).alias("cohort"),
                F.col(f"{name}_n").alias("n"),
                F.col(f"{name}_score").alias("avg_score"),
                F.col(f"{name}_rate").alias("bad_rate"),
                F.col(f"{name}_level0").alias("high_share"),
                F.col(f"{name}_level1").alias("mid_share"),
                F.col(f"{name}_level2").alias("low_share"),
            )
            for i, (name, _) in enumerate(cohorts)
        ]
    )
    return needed.agg(*aggregates).select(F.inline(rows))


def _taken(score: str, decimals: int | None) -> Column:
    return F.col(score) if decimals is None else F.round(score, decimals)


def _paired_counts(
    view: DataFrame, target: str | None, base: str | None, score: str, decimals: int | None
) -> DataFrame:
    """Rows per distinct score in each cohort."""
    flags = view.select(
        _taken(score, decimals).alias("score"), compared(base).alias("b"), member(target).alias("t")
    )
    return (
        flags.where("(b OR t) AND score IS NOT NULL")
        .groupBy("score")
        .agg(F.count_if("b").alias("n_base"), F.count_if("t").alias("n_target"))
    )


def score_bins(
    view: DataFrame,
    target: str | None,
    base: str | None,
    bins: int = 10,
    score: str = "risk_score",
    decimals: int | None = None,
) -> DataFrame:
    """Counts of both cohorts between the base cohort's quantiles, empty bins included.

    The outer bins are open-ended, a bin holds its left edge, and equal quantiles merge. Scores
    count as they come. ``decimals`` rounds them first, for probabilities stored at that many: they
    then collapse to few rows and need no cut order.
    """
    return _all_bins(_binned(view, target, base, bins, score, decimals))


def _binned(
    view: DataFrame, target: str | None, base: str | None, bins: int, score: str, decimals: int | None
) -> DataFrame:
    """``bin, n_base, n_target, n_edges`` for the bins that hold anything."""
    counts = _paired_counts(view, target, base, score, decimals)
    probs = [i / bins for i in range(bins + 1)]
    if decimals is None:
        counts = stored(counts)
        quantiles = exact_quantiles(counts.where("n_base > 0"), "score", "n_base", probs).scalar()
    else:
        # the caller has asked for few distinct scores: the quantiles ride along as a window
        grid = F.array(*[F.lit(p) for p in probs])
        share = F.when(F.col("n_base") > 0, F.col("score"))
        quantiles = F.percentile(share, grid, F.col("n_base")).over(Window.partitionBy())
    distinct = F.array_sort(F.array_distinct(F.col("quantiles")))
    inner = F.slice(distinct, F.lit(2), F.greatest(F.size(distinct) - 2, F.lit(0)))
    place = F.size(F.filter("edges", lambda e: e <= F.col("score")))
    return (
        counts.withColumn("quantiles", quantiles)
        .withColumn("edges", F.coalesce(inner, F.array().cast("array<double>")))
        .groupBy(place.alias("bin"))
        .agg(
            F.sum("n_base").alias("n_base"),
            F.sum("n_target").alias("n_target"),
            F.max(F.size("edges")).alias("n_edges"),
        )
    )


def _all_bins(binned: DataFrame) -> DataFrame:
    """Fill in the empty bins: there is one more bin than inner edges."""
    held = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n_base", "n_target"))))
    row = binned.agg(F.max("n_edges").alias("last"), held.alias("held"))
    every = row.select("held", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bin"))
    found = F.try_element_at("held", F.col("bin"))
    return every.select(
        "bin",
        F.coalesce(found["n_base"], F.lit(0)).alias("n_base"),
        F.coalesce(found["n_target"], F.lit(0)).alias("n_target"),
    )


def psi_label(value: Column) -> Column:
    return (
        F.when(value < PSI_SLIGHT, "稳定").when(value < PSI_LARGE, "轻微偏移").otherwise("显著偏移")
    )


def psi(
    view: DataFrame,
    target: str | None,
    base: str | None,
    bins: int = 10,
    score: str = "risk_score",
    decimals: int | None = None,
) -> DataFrame:
    """Population stability index of the target against the base: one row, null without a base."""
    everyone = Window.partitionBy()
    # a bin that both cohorts lack adds nothing
    shares = _binned(view, target, base, bins, score, decimals).select(
        *[
            F.greatest(
                ratio(F.col(f"n_{s}"), F.sum(f"n_{s}").over(everyone)), F.lit(PSI_FLOOR)
            ).alias(s)
            for s in ("base", "target")
        ],
        (F.sum("n_base").over(everyone) > 0).alias("has_base"),
        (F.sum("n_target").over(everyone) > 0).alias("has_target"),
    )
    gain = (F.col("target") - F.col("base")) * F.log(F.col("target") / F.col("base"))
    return shares.agg(F.sum(F.when(F.expr("has_base AND has_target"), gain)).alias("psi")).select(
        "psi", F.when(F.col("psi").isNotNull(), psi_label(F.col("psi"))).alias("shift")
    )


def histogram(view: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts between given edges: left-closed bins, the last one closed on both sides."""
    value = F.col(column)
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value)) - 1
    place = F.when(value == float(edges[-1]), len(edges) - 2).otherwise(place)
    inside = view.where((value >= float(edges[0])) & (value <= float(edges[-1])))
    counted = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spans = F.array(
        *[
            F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))
        ]
    )
    every = view.sparkSession.range(1).select(F.inline(spans))
    return every.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def score_counts(
    view: DataFrame,
    keys: list[str],
    label: str = "is_bad",
    score: str = "risk_score",
    decimals: int | None = None,
) -> DataFrame:
    """Positives and negatives per distinct score (and key)."""
    known = view.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*keys, _taken(score, decimals).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def roc_points(
    view: DataFrame,
    keys: list[str] | None = None,
    label: str = "is_bad",
    score: str = "risk_score",
    decimals: int | None = None,
) -> DataFrame:
    """True and false positive rate at every score threshold, from the highest score down.

    ``decimals`` as for ``score_bins``.
    """
    keys = keys or []
    counts = score_counts(view, keys, label, score, decimals)
    if decimals is None:
        run = running_totals(counts, keys, "score", ["pos", "neg"], descending=True)
    else:
        # the caller has asked for few distinct scores per key
        above = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(
            Window.unboundedPreceding, -1
        )
        run = counts.select(
            "*",
            *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_before") for c in ("pos", "neg")],
            *[F.sum(c).over(Window.partitionBy(*keys)).alias(f"{c}_total") for c in ("pos", "neg")],
        )
    return run.select(
        *keys,
        "score",
        "pos",
        "neg",
        "pos_before",
        "pos_total",
        "neg_total",
        ratio(F.col("pos_before") + F.col("pos"), F.col("pos_total")).alias("tpr"),
        ratio(F.col("neg_before") + F.col("neg"), F.col("neg_total")).alias("fpr"),
    )


def auc_ks(
    view: DataFrame,
    keys: list[str] | None = None,
    label: str = "is_bad",
    score: str = "risk_score",
    decimals: int | None = None,
) -> DataFrame:
    """``n, auc, ks`` per key; both null when only one label occurs.

    Equal scores get half credit in the AUC; the KS gap starts at 0.
    """
    keys = keys or []
    points = roc_points(view, keys, label, score, decimals)
    # a negative at this score loses against every positive above it and ties with those beside it
    won = F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / F.lit(2.0))
    gap = F.greatest(F.col("tpr") - F.col("fpr"), F.lit(0.0))
    both = (F.max("pos_total") > 0) & (F.max("neg_total") > 0)
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return points.groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.when(both, F.sum(won) / F.nullif(pairs, F.lit(0.0))).alias("auc"),
        F.when(both, F.max(gap)).alias("ks"),
    )


def performance(
    view: DataFrame, expression: str | None = None, decimals: int | None = None
) -> DataFrame:
    """Test-split size, rate, mean score, AUC and KS of a cohort."""
    part = cohort(view.where(F.col("dataset") == "test"), expression)
    # collapsed to scores, everything else follows from the counts
    points = roc_points(part, decimals=decimals)
    won = F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / F.lit(2.0))
    size = F.col("pos") + F.col("neg")
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return points.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("n"),
        ratio(F.sum("pos"), F.sum(size)).alias("bad_rate"),
        ratio(F.sum(F.col("score") * size), F.sum(size)).alias("avg_score"),
        F.when(both, F.sum(won) / F.nullif(pairs, F.lit(0.0))).alias("auc"),
        F.when(both, F.max(F.greatest(F.col("tpr") - F.col("fpr"), F.lit(0.0)))).alias("ks"),
    )


def grouped_auc(view: DataFrame, by: str, decimals: int | None = None) -> DataFrame:
    """Test-split AUC and KS per group."""
    return auc_ks(view.where(F.col("dataset") == "test"), [by], decimals=decimals)


def weakest_group(view: DataFrame, by: str, decimals: int | None = None) -> DataFrame:
    """The group the score separates worst."""
    first = F.min(F.struct(F.col("auc"), F.col(by).alias("g")))
    return (
        grouped_auc(view, by, decimals)
        .where(F.col("auc").isNotNull())
        .agg(first.alias("m"))
        .select(F.col("m.g").alias(by), F.col("m.auc").alias("auc"))
    )


def split_gap(view: DataFrame, decimals: int | None = None) -> DataFrame:
    """AUC per split beside the gap of the training split over the test split."""
    per = auc_ks(view, ["dataset"], decimals=decimals)
    test = F.max(F.when(F.col("dataset") == "test", F.col("auc"))).over(Window.partitionBy())
    return per.withColumn("gap_to_test", F.col("auc") - test)


def calibration(view: DataFrame, by: str | None = None) -> DataFrame:
    """Mean score beside the observed rate."""
    return (
        view.groupBy(*([by] if by else []))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("risk_score").alias("avg_score"),
            F.avg("is_bad").alias("bad_rate"),
        )
        .withColumn("gap", F.col("avg_score") - F.col("bad_rate"))
    )
