"""Features, stratified split and the metrics record as batch jobs; ``boosting`` trains on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from shiftlens.catalog import RAW_FEATURES, REPAY_RATIO_CAP, STATUS_COLUMNS, worst_status
from shiftlens.functions.numeric import ratio, uniform_draw
from shiftlens.operators.monitor import auc_ks
from shiftlens.operators.ordering import null_safe_join

# Fixed value: split share.
HOLDOUT = 0.2

SPLIT_SALT = 11
SPLIT_CUTS = 4096


def repay_ratio() -> Column:
    """Latest payment over the previous bill, capped above; null without a positive bill."""
    previous = F.col("bill_amt_2")
    paid = ratio(F.col("pay_amt_1"), previous)
    capped = F.when(paid > REPAY_RATIO_CAP, F.lit(REPAY_RATIO_CAP)).otherwise(paid)
    return F.when(previous > 0, capped)


def build_features(loans: DataFrame, *keep: str) -> DataFrame:
    """The 23 raw and 4 derived features in their fixed order, after the columns to keep."""
    overdue = sum(
        (F.coalesce((F.col(c) >= 1).cast("int"), F.lit(0)) for c in STATUS_COLUMNS), F.lit(0)
    )
    return loans.select(
        *keep,
        *RAW_FEATURES,
        ratio(F.col("bill_amt_1"), F.col("credit_limit")).alias("utilization_1"),
        worst_status().alias("max_pay_status"),
        overdue.alias("n_overdue_months"),
        repay_ratio().alias("repay_ratio_1"),
    )


def stratified_split(
    df: DataFrame, key: str = "user_id", label: str = "is_bad", share: float = HOLDOUT
) -> DataFrame:
    """Add ``dataset``: exact test, then validation shares per label, by a repeatable draw.

    The draw is even, so cutting it evenly bounds every cut: ranks are exact without sorting one
    label in one task.
    """
    drawn = df.withColumn("__u", uniform_draw(F.col(key), SPLIT_SALT)).withColumn(
        "__cut", F.floor(F.col("__u") * SPLIT_CUTS)
    )
    cuts = drawn.groupBy(label, "__cut").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(label).orderBy("__cut").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = cuts.select(
        label, "__cut", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before")
    )
    classes = cuts.groupBy(label).agg(F.sum("n").alias("n"))
    # one row per label from here on
    everyone = Window.partitionBy()

    def allot(table: DataFrame, size: str, name: str) -> DataFrame:
        """Share out ceil(share · total) by largest remainder."""
        total = F.sum(size).over(everyone)
        want = F.ceil(total * F.lit(share))
        exact = want * F.col(size) / total
        out = table.withColumn("__want", want).withColumn("__exact", exact)
        out = out.withColumn("__floor", F.floor("__exact"))
        spare = F.col("__want") - F.sum("__floor").over(everyone)
        place = F.row_number().over(
            Window.partitionBy().orderBy(F.desc(F.col("__exact") - F.col("__floor")), label)
        )
        return out.withColumn(
            name, F.col("__floor") + F.when(place <= spare, 1).otherwise(0)
        ).drop("__want", "__exact", "__floor")

    allotted = allot(classes, "n", "n_test").withColumn("rest", F.col("n") - F.col("n_test"))
    allotted = allot(allotted, "rest", "n_valid").select(label, "n_test", "n_valid")
    table = null_safe_join(offsets, allotted, [label])
    inside = Window.partitionBy(label, "__cut").orderBy("__u", key)
    rank = F.col("__before") + F.row_number().over(inside)
    return (
        null_safe_join(drawn, table, [label, "__cut"])
        .withColumn("__rank", rank)
        .withColumn(
            "dataset",
            F.when(F.col("__rank") <= F.col("n_test"), "test")
            .when(F.col("__rank") <= F.col("n_test") + F.col("n_valid"), "valid")
            .otherwise("train"),
        )
        .select(*df.columns, "dataset")
    )


def metrics_record(scored: DataFrame, best_iteration: Column | int, n_features: int) -> DataFrame:
    """One row of test AUC and KS, training AUC and split sizes, on unrounded scores."""
    per = auc_ks(scored, ["dataset"], score="score")

    def of(split: str, column: str) -> Column:
        return F.max(F.when(F.col("dataset") == split, F.col(column)))

    return per.agg(
        F.round(of("test", "auc"), 4).alias("test_auc"),
        F.round(of("test", "ks"), 4).alias("test_ks"),
        F.round(of("train", "auc"), 4).alias("train_auc"),
        F.first(F.lit(best_iteration)).alias("best_iteration"),
        F.first(F.lit(n_features)).alias("n_features"),
        *[F.coalesce(of(s, "n"), F.lit(0)).alias(f"n_{s}") for s in ("train", "valid", "test")],
    )
