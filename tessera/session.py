"""A Spark session with the settings the engine is meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE with skew joins and coalescing, UTC, Arrow.  On a cluster leave ``shuffle_partitions`` unset:
    AQE coalesces from a high initial number, so partitions follow the data's size."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4096",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        settings.pop("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
