"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "skein", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots written as `__`."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
