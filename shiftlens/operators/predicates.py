"""Checks of cohort expressions before they run: literals against the values that exist, and nothing but conditions.

A misspelt value gives an empty cohort that looks like a result. Expressions come as rows, so a whole
history of them is checked in one job; ``checked`` refuses a single one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.operators.cohort import cohort

LITERAL = r"'((?:[^']|'')*)'"
COMPARED = r"(?:=|<>|!=|>=|<=|>|<)"
#: Neither a comment, nor a further statement, nor anything that reads or writes by itself.
BREAKS = r";|--|/\*"
WORDS = r"(?i)\b(select|with|insert|update|delete|drop|create|alter|truncate|merge|copy|call)\b"


def literals(expression: Column, column: str) -> Column:
    """The text literals that an expression compares ``column`` with."""
    name = rf"(?i)(?<![\w.]){column}"
    after = F.regexp_extract_all(expression, F.lit(rf"{name}\s*{COMPARED}\s*{LITERAL}"), F.lit(1))
    before = F.regexp_extract_all(expression, F.lit(rf"{LITERAL}\s*{COMPARED}\s*{name}\b"), F.lit(1))
    lists = F.regexp_extract_all(
        expression, F.lit(rf"{name}\s+(?:not\s+)?in\s*\(((?:\s*{LITERAL}\s*,?)+)\)"), F.lit(1)
    )
    listed = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(LITERAL), F.lit(1))))
    return F.transform(F.concat(after, before, listed), lambda x: F.replace(x, F.lit("''"), F.lit("'")))


def domain(view: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, literal``: the values that occur."""
    pair = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("literal"))
    cells = F.array(*map(pair, columns))
    return view.select(F.inline(cells)).where("literal IS NOT NULL").distinct()


def filter_findings(
    filters: DataFrame,
    known: DataFrame,
    columns: list[str],
    formats: dict[str, str] | None = None,
    expression: str = "filter",
) -> DataFrame:
    """The other columns of ``filters`` with ``check_name, subject, severity`` for each problem.

    ``known`` comes from ``domain``; ``formats`` are patterns for the literals of further columns.
    """
    keys = [c for c in filters.columns if c != expression]
    text = F.col(expression)
    found = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), literals(text, c).alias("literals"))
            for c in [*columns, *(formats or {})]
        ]
    )
    pairs = (
        filters.select(*keys, F.inline(found))
        .select(*keys, "column_name", F.explode(F.array_distinct("literals")).alias("literal"))
    )

    def problems(rows: DataFrame, check: str) -> DataFrame:
        return rows.select(
            *keys,
            F.lit(check).alias("check_name"),
            F.concat_ws("=", "column_name", "literal").alias("subject"),
            F.lit("error").alias("severity"),
        )

    unknown = pairs.where(F.col("column_name").isin(*columns)).join(
        known, ["column_name", "literal"], "left_anti"
    )
    out = problems(unknown, "unknown_value")
    for c, pattern in (formats or {}).items():
        odd = pairs.where((F.col("column_name") == c) & ~F.col("literal").rlike(pattern))
        out = out.unionByName(problems(odd, "odd_format"))
    return out.unionByName(refused(filters, expression))


def refused(filters: DataFrame, expression: str = "filter") -> DataFrame:
    """Expressions that are more than a condition; what stands between quotes is data."""
    keys = [c for c in filters.columns if c != expression]
    bare = F.regexp_replace(expression, LITERAL, "''")
    check = F.when(bare.rlike(BREAKS), "comment_or_statement").when(bare.rlike(WORDS), "subquery_or_command")
    stopped = filters.select(*keys, check.alias("check_name"), F.col(expression).alias("subject"))
    return stopped.where("check_name IS NOT NULL").withColumn("severity", F.lit("error"))


def checked(
    view: DataFrame, expression: str, known: DataFrame, columns: list[str], formats: dict[str, str] | None = None
) -> DataFrame:
    """The cohort of an expression that has no problem; otherwise an error that names them all."""
    asked = view.sparkSession.createDataFrame([(expression,)], "filter string")
    found = [f"{r['check_name']}: {r['subject']}" for r in filter_findings(asked, known, columns, formats).collect()]
    if found:
        raise ValueError("; ".join(sorted(found)))
    return cohort(view, expression)
