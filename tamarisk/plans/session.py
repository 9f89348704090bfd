"""A session with the settings the engine is meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tamarisk.plans.scale import ship


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Session in UTC with adaptive execution; ``conf`` takes further settings with ``__`` for dots."""
    b = SparkSession.builder.appName("tamarisk").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship(spark)
    return spark
