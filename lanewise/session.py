"""Spark session with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lanewise", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC clock, adaptive execution, checkpoints that go with what reads them; all
    else is the cluster's own."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
