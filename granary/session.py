"""A Spark session set up for large scans; everything here is a default that the caller or spark-submit may override."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    # partitions are sized at run time: start with many and let small ones be joined and skewed ones be split
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    # columns are built by the hundred; their call sites are not recorded
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(name: str = "granary", **settings: str) -> SparkSession:
    """The running session, or a new one. A setting given as spark__sql__x=... stands for spark.sql.x."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
