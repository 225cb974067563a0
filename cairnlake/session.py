"""Sessions with the settings that the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "cairnlake", **conf: str) -> SparkSession:
    """UTC, adaptive execution, Kryo; anything else, such as the master, comes from conf."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
