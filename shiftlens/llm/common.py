"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shiftlens.session import shared_folder

#: One Arrow batch holds at most so many rows; texts may be long.
BATCH_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text, 256)


def kept_aside(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back with its schema.

    What follows no longer depends on the tasks that made it, so lost executors cost nothing.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
