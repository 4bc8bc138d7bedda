"""Repeatable weighted draws of business fields, with planted effects for testing scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.catalog import CHANNELS, CITY_TIERS, MONTHS
from shiftlens.functions.numeric import uniform_draw

# Draw weights per profile, in the order of the value lists.
CHANNEL_DEFAULT = [0.35, 0.25, 0.20, 0.20]
CHANNEL_YOUNG_LOW = [0.25, 0.45, 0.20, 0.10]
CHANNEL_SENIOR = [0.30, 0.10, 0.20, 0.40]
SENIOR_AGE = 45
CITY_WEIGHTS = [0.3, 0.4, 0.3]
SURGE_MONTHS, SURGE_FACTOR, DRAIN_FACTOR = [10, 11, 12], 12.0, 0.3
SPIKE_MONTHS, SPIKE_FACTOR = [6], 8.0

CHANNEL_SALT, MONTH_SALT, CITY_SALT = 1, 2, 3


def weighted_choice(values: list[str], weights: Column, draw: Column) -> Column:
    """The value whose share of the (unnormalised) weights holds the draw from [0, 1)."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    start = F.struct(
        F.lit(0.0).alias("sum"), F.lit(0).alias("hits"), (draw * total).alias("mark")
    )
    passed = F.aggregate(
        weights,
        start,
        lambda acc, w: F.struct(
            (acc["sum"] + w).alias("sum"),
            (acc["hits"] + (acc["sum"] + w <= acc["mark"]).cast("int")).alias("hits"),
            acc["mark"].alias("mark"),
        ),
        lambda acc: F.least(acc["hits"], F.lit(len(values) - 1)),
    )
    return F.get(F.array(*[F.lit(v) for v in values]), passed)


def _row(weights: list[float]) -> Column:
    return F.array(*[F.lit(float(w)) for w in weights])


def young_low() -> Column:
    return (F.col("age") <= 30) & (F.col("credit_limit") <= 50000)


def assign_channel(df: DataFrame, values: list[str] = CHANNELS) -> DataFrame:
    """Channel by profile; the senior profile goes before the young one."""
    weights = (
        F.when(F.col("age") >= SENIOR_AGE, _row(CHANNEL_SENIOR))
        .when(young_low(), _row(CHANNEL_YOUNG_LOW))
        .otherwise(_row(CHANNEL_DEFAULT))
    )
    draw = uniform_draw(F.col("user_id"), CHANNEL_SALT)
    return df.withColumn("channel", weighted_choice(values, weights, draw))


def assign_month(
    df: DataFrame,
    values: list[str] = MONTHS,
    surge_channel: str = CHANNELS[1],
    spike_channel: str = CHANNELS[2],
) -> DataFrame:
    """Month, even but for two planted effects.

    The surge channel's young low-limit customers crowd into the last quarter and its others leave
    it; the spike channel's overdue customers crowd into June.
    """
    surge = F.col("channel") == surge_channel
    young = F.coalesce(young_low(), F.lit(False))
    spike = (F.col("channel") == spike_channel) & (F.col("pay_status_1") >= 1)
    weights = []
    for month in range(1, len(values) + 1):
        w = F.lit(1.0)
        if month in SURGE_MONTHS:
            w = F.when(surge & young, SURGE_FACTOR).when(surge, DRAIN_FACTOR).otherwise(w)
        if month in SPIKE_MONTHS:
            w = F.when(spike, SPIKE_FACTOR).otherwise(w)
        weights.append(w)
    draw = uniform_draw(F.col("user_id"), MONTH_SALT)
    return df.withColumn("loan_month", weighted_choice(values, F.array(*weights), draw))


def assign_city(df: DataFrame, values: list[str] = CITY_TIERS) -> DataFrame:
    """City tier, independent of everything else."""
    draw = uniform_draw(F.col("user_id"), CITY_SALT)
    return df.withColumn("city_tier", weighted_choice(values, _row(CITY_WEIGHTS), draw))


def assign_business_fields(df: DataFrame) -> DataFrame:
    return assign_city(assign_month(assign_channel(df)))
