"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even where the plan after it then needs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call-site capture per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app: str = "shiftlens", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the defaults the operators are planned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to the machine's own temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join("/tmp", "shiftlens")
    return f"{root.rstrip('/')}/shiftlens-{uuid.uuid4().hex}"
