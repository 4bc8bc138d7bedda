"""Data-quality counts over the base view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.catalog import (
    AGE_RANGE,
    EDUCATION_CODES,
    MARRIAGE_CODES,
    STATUS_COLUMNS,
    STATUS_RANGE,
)
from shiftlens.functions.numeric import ratio
from shiftlens.operators.cohort import cohort


def undefined(column: str, codes: list) -> Column:
    """Outside the defined codes; a missing code is undefined too."""
    return ~F.coalesce(F.col(column).isin(codes), F.lit(False))


def outside(column: str, lo: float, hi: float) -> Column:
    return F.coalesce((F.col(column) < lo) | (F.col(column) > hi), F.lit(False))


def quality_rules() -> dict[str, Column]:
    any_status = F.lit(False)
    for c in STATUS_COLUMNS:
        any_status = any_status | outside(c, *STATUS_RANGE)
    return {
        "education_undefined": undefined("education", EDUCATION_CODES),
        "marriage_undefined": undefined("marriage", MARRIAGE_CODES),
        "bill_amt_1_negative": F.col("bill_amt_1") < 0,
        "age_out_of_range": outside("age", *AGE_RANGE),
        "credit_limit_not_positive": F.col("credit_limit") <= 0,
        "pay_status_out_of_range": any_status,
    }


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if df.schema[name].dataType.typeName() in ("float", "double") else c.isNull()


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, n_null`` for every column from one aggregate row."""
    names = columns or df.columns
    row = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in names])
    return row.unpivot([], names, "column_name", "n_null")


def quality_check(
    view: DataFrame,
    expression: str | None = None,
    rules: dict[str, Column] | None = None,
    null_columns: list[str] | None = None,
) -> DataFrame:
    """``check_name, n_rows, n_hit, share`` per rule and per column with nulls, in one pass.

    Columns without nulls give no row; ``total`` carries the cohort size.
    """
    rules = rules or quality_rules()
    names = null_columns or view.columns
    row = cohort(view, expression).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(missing(view, c)).alias(f"null_{c}") for c in names],
        *[F.count_if(rule).alias(f"rule_{name}") for name, rule in rules.items()],
    )
    found = F.array(
        F.struct(F.lit("total").alias("check_name"), F.col("n_rows").alias("n_hit")),
        *[
            F.struct(F.lit(f"null:{c}").alias("check_name"), F.col(f"null_{c}").alias("n_hit"))
            for c in names
        ],
        *[
            F.struct(F.lit(n).alias("check_name"), F.col(f"rule_{n}").alias("n_hit"))
            for n in rules
        ],
    )
    rows = row.select("n_rows", F.inline(found)).where(
        ~(F.col("check_name").startswith("null:") & (F.col("n_hit") == 0))
    )
    share = ratio(F.col("n_hit"), F.greatest(F.col("n_rows"), F.lit(1)))
    return rows.select("check_name", "n_rows", "n_hit", share.alias("share"))
