"""Survey, weather and forecast analytics on Spark, and corpus operators beside them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tallywing", **conf: str) -> SparkSession:
    """A session with UTC clocks and adaptive plans; conf's underscores stand for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
