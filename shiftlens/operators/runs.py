"""Summaries over stored run records (one row per answered question and system)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftlens.functions.numeric import ratio
from shiftlens.operators.ordering import exact_quantiles, null_safe_join


def latest(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record per key by ``order``; an aggregate, so a hot key is combined map-side."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("__r")
    ).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def pending(questions: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Questions without a result yet."""
    return questions.join(done.select(*keys), keys, "left_anti")


def requested(
    questions: DataFrame, wanted: DataFrame, key: str = "id", first: int | None = None
) -> DataFrame:
    """The wanted questions; with ``first`` only so many of them, by key."""
    found = questions.join(wanted.select(key), key, "left_semi")
    return found if first is None else found.orderBy(key).limit(first)


def with_cost(records: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost``: tokens per kind times the model's price per million; unlisted models are free.

    ``prices`` is ``model, price map<string, double>``.
    """
    priced = records.join(prices, "model", "left")
    parts = F.transform(
        F.map_entries(F.coalesce("price", F.create_map().cast("map<string,double>"))),
        lambda e: F.coalesce(F.try_element_at(F.col("usage"), e["key"]), F.lit(0)) * e["value"],
    )
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return priced.withColumn("cost", total / F.lit(1e6)).drop("price")


def system_summary(records: DataFrame) -> DataFrame:
    """Size, success, completion, latency, tool calls and cost per system.

    The latency quantile is cut out of running totals: one system may hold most of the records.
    """
    latency = elapsed_quantiles(records, [0.9], ["system"])
    means = records.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.avg(F.col("executed").cast("int")).alias("completion_rate"),
        F.avg("elapsed").alias("avg_elapsed"),
        F.avg("n_tool_calls").alias("avg_tool_calls"),
        F.avg("cost").alias("avg_cost"),
    )
    p90 = latency.select("system", F.col("quantiles")[0].alias("p90_elapsed"))
    return null_safe_join(means, p90, ["system"], "left")


def elapsed_quantiles(
    records: DataFrame, probs: list[float], keys: list[str] | None = None
) -> DataFrame:
    """Exact latency quantiles (per key)."""
    keys = keys or []
    counts = records.groupBy(*keys, "elapsed").agg(F.count(F.lit(1)).alias("n"))
    return exact_quantiles(counts, "elapsed", "n", probs, keys)


def category_matrix(records: DataFrame, systems: list[str]) -> DataFrame:
    """``k/n`` successes per category and system, '-' where there is no record."""
    cell = F.concat(
        F.count_if("success").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")
    )
    wide = records.groupBy("category").pivot("system", systems).agg(cell)
    return wide.select("category", *[F.coalesce(f"`{s}`", F.lit("-")).alias(s) for s in systems])


def category_success(records: DataFrame) -> DataFrame:
    return records.groupBy("category", "system").agg(
        F.count_if("success").alias("k"),
        F.count(F.lit(1)).alias("n"),
        ratio(F.count_if("success"), F.count(F.lit(1))).alias("success_rate"),
    )


def failures(records: DataFrame) -> DataFrame:
    """``id, question, why`` of unsuccessful records: the failed checks' notes, else the status."""
    failed = F.filter("grade.checks", lambda c: ~c["passed"])
    notes = F.array_join(F.transform(failed, lambda c: c["note"]), "; ")
    why = F.when(notes != "", notes).otherwise(F.col("status"))
    return records.where(~F.col("success")).select("id", "question", why.alias("why"))


def tool_usage(records: DataFrame) -> DataFrame:
    """Calls, errors and mean time per tool out of the nested steps."""
    steps = records.select(F.explode("steps").alias("s")).where("s.kind = 'tool_result'")
    return steps.groupBy(F.col("s.tool").alias("tool")).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if("s.is_error").alias("n_errors"),
        F.avg("s.elapsed").alias("avg_elapsed"),
    )


def step_counts(records: DataFrame) -> DataFrame:
    """Tool calls and errors per record, recounted from its steps."""
    results = F.filter("steps", lambda s: s["kind"] == "tool_result")
    return records.select(
        "id",
        F.size(results).alias("n_tool_calls"),
        F.size(F.filter(results, lambda s: s["is_error"])).alias("n_tool_errors"),
    )
