"""Tables laid out for their joins: bucketed on the user and partitioned by month.

Facts, scores and attribution sums in as many buckets join on the user without an exchange, and a filter on
months reads only their folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

BUCKETS = 32


def write_laid_out(
    df: DataFrame, path: str, key: str = "user_id", month: str | None = None, buckets: int = BUCKETS
) -> str:
    """Write the table below ``path`` and return its name.

    Rows are dealt by their bucket first, so that a bucket is one file (for each month).
    """
    name = f"laid_out_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
    if month:
        writer = writer.partitionBy(month)
    writer.saveAsTable(name)
    return name
