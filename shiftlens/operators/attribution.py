"""Per-feature score attributions in long form (``user_id, feature, shap_value``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from shiftlens.functions.numeric import logit, ratio
from shiftlens.operators.cohort import cohort, member


def to_long(wide: DataFrame, features: list[str]) -> DataFrame:
    return wide.unpivot("user_id", features, "feature", "shap_value")


def linear_attributions(view: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """Attributions of a linear score: each term minus its mean. Exactly additive in log-odds."""
    named = view.select("user_id", *[t.alias(name) for name, t in terms.items()])
    means = named.agg(F.struct(*[F.avg(n).alias(n) for n in terms])).scalar()
    centred = named.withColumn("__m", means)
    return centred.select("user_id", *[(F.col(n) - F.col(f"__m.{n}")).alias(n) for n in terms])


def _per_user_feature(shap: DataFrame, members: DataFrame) -> DataFrame:
    """Sums per (user, feature) for the cohort's users.

    The join leaves the rows placed by user, so this grouping needs no further exchange, and what
    follows is one small row per feature from every task. Counting its rows counts users.
    """
    joined = shap.join(members, "user_id", "inner")
    flags = [c for c in members.columns if c != "user_id"]
    return joined.groupBy("user_id", "feature", *flags).agg(
        F.sum("shap_value").alias("s"),
        F.sum(F.abs("shap_value")).alias("a"),
        F.count("shap_value").alias("c"),
    )


def importance(
    shap: DataFrame, view: DataFrame, target: str | None = None, top_k: int | None = 8
) -> DataFrame:
    """Mean absolute and mean attribution per feature, largest mean absolute first."""
    sums = _per_user_feature(shap, cohort(view, target).select("user_id"))
    out = (
        sums.groupBy("feature")
        .agg(
            ratio(F.sum("a"), F.sum("c")).alias("mean_abs_shap"),
            ratio(F.sum("s"), F.sum("c")).alias("mean_shap"),
            F.count(F.lit(1)).alias("n_users"),
        )
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )
    return out.limit(top_k) if top_k else out


def global_importance(shap: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature over everyone; no join needed."""
    return (
        shap.groupBy("feature")
        .agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )


def compare(
    shap: DataFrame, view: DataFrame, target: str, base: str | None = None, top_k: int | None = 8
) -> DataFrame:
    """Mean attribution of both cohorts per feature, sorted by what raises the target most.

    ``total_diff``, of which ``share_of_total`` is a part, is the sum over all features, before the cut to
    ``top_k``; ``n_base`` and ``n_target`` are the users with attributions. Without ``base`` this is the target's
    ``importance``.
    """
    if not (base and base.strip()):
        return importance(shap, view, target, top_k)
    members = view.select(
        "user_id", member(base).alias("in_base"), member(target).alias("in_target")
    ).where("in_base OR in_target")
    sums = _per_user_feature(shap, members)

    def mean(side: str) -> Column:
        inside = F.col(f"in_{side}")
        return ratio(F.sum(F.when(inside, F.col("s"))), F.sum(F.when(inside, F.col("c"))))

    per = (
        sums.groupBy("feature")
        .agg(
            F.count_if("in_base").alias("n_base"),
            F.count_if("in_target").alias("n_target"),
            mean("base").alias("mean_shap_base"),
            mean("target").alias("mean_shap_target"),
        )
        .where("mean_shap_base IS NOT NULL AND mean_shap_target IS NOT NULL")
        .withColumn("diff", F.col("mean_shap_target") - F.col("mean_shap_base"))
    )
    total = F.sum("diff").over(Window.partitionBy())
    per = per.withColumn("total_diff", total)
    out = per.withColumn("share_of_total", ratio(F.col("diff"), F.col("total_diff"))).orderBy(
        F.desc("diff"), "feature"
    )
    return out.limit(top_k) if top_k else out


def _with_sums(shap: DataFrame, scores: DataFrame) -> DataFrame:
    sums = shap.groupBy("user_id").agg(F.sum("shap_value").alias("shap_sum"))
    return scores.select("user_id", logit(F.col("risk_score")).alias("log_odds")).join(
        sums, "user_id", "inner"
    )


def base_value(shap: DataFrame, scores: DataFrame) -> DataFrame:
    """The constant of the attributions: mean of log-odds minus the user's summed attributions."""
    return _with_sums(shap, scores).agg(
        F.avg(F.col("log_odds") - F.col("shap_sum")).alias("base_value")
    )


def additivity(shap: DataFrame, view: DataFrame, target: str | None = None) -> DataFrame:
    """Mean log-odds of a cohort against base value plus its summed mean attributions."""
    members = view.select("user_id", "risk_score", member(target).alias("t"))
    sums = shap.groupBy("user_id").agg(F.sum("shap_value").alias("shap_sum"))
    per_user = members.join(sums, "user_id", "left").withColumn(
        "log_odds", logit(F.col("risk_score"))
    )
    inside = F.col("t")
    return per_user.agg(
        F.count_if(inside).alias("n"),
        F.avg(F.when(inside, F.col("log_odds"))).alias("mean_log_odds"),
        F.avg(F.when(inside, F.col("shap_sum"))).alias("mean_shap_sum"),
        F.avg(F.col("log_odds") - F.col("shap_sum")).alias("base_value"),
    ).withColumn(
        "gap",
        F.abs(F.col("mean_log_odds") - (F.col("base_value") + F.col("mean_shap_sum"))),
    )


def entity_reasons(
    shap: DataFrame, view: DataFrame, k: int = 2, target: str | None = None
) -> DataFrame:
    """Score and the k highest signed attributions of every user of a cohort."""
    chosen = cohort(view, target).select("user_id", "risk_score")
    order = Window.partitionBy("user_id").orderBy(F.desc("shap_value"), "feature")
    # the window reuses the placement by user that the join made
    ranked = shap.join(chosen, "user_id", "inner").withColumn(
        "reason_rank", F.row_number().over(order)
    )
    return ranked.where(F.col("reason_rank") <= k).select(
        "user_id", "risk_score", "reason_rank", "feature", "shap_value"
    )
