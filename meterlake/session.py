"""Session set-up. A cluster session that already exists is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where it costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(
    app: str = "meterlake", master: str | None = None, shuffle_partitions: int | None = None, scratch: str | None = None
) -> SparkSession:
    """``scratch`` is the shared folder for written intermediate tables (``spark.checkpoint.dir``)."""
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("METERLAKE_MASTER")
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if master and master.startswith("local"):
        # one JVM holds driver and tasks; the setting counts only before that JVM starts
        builder = builder.config("spark.driver.memory", os.environ.get("METERLAKE_MEMORY", "8g"))
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
