"""Continuous monitoring: counts and rates per window of event time, from a folder that files arrive in.

Every batch hands over the windows that it changed, in a folder named by its number, so a batch that is run
again after a failure replaces its own rows. What was read, the open windows and the watermark are in the
checkpoint folder; a stopped query goes on from there. Rows that come after their window is closed are dropped
by the watermark and counted in the query's progress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


def windowed(
    events: DataFrame,
    by: list[str],
    time: str = "ts",
    width: str = "1 day",
    delay: str = "1 day",
    aggregates: dict[str, Column] | None = None,
) -> DataFrame:
    """``start, by..., n`` and the given sums per window; the same for a batch and for a stream."""
    more = [c.alias(name) for name, c in (aggregates or {}).items()]
    return (
        events.withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("__w"), *by)
        .agg(F.count(F.lit(1)).alias("n"), *more)
        .select(F.col("__w.start").alias("start"), *by, "n", *(aggregates or {}))
    )


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """Files of a folder in the order of their arrival, at most ``files`` in a batch.

    A batch should hold what arrived together: rows are late by what earlier batches have seen.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def follow(windows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Takes in all that has arrived and ends; a later call goes on with what has come since."""

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        windows.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that this run of the query has dropped as too late."""
    return sum(
        s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]
    )


def current(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    """The last state of every window."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in ("start", "batch", *by)]
    last = F.max_by(F.struct(*rest), F.col("batch")).alias("r")
    return rows.groupBy("start", *by).agg(last).select("start", *by, *[f"r.{c}" for c in rest])
