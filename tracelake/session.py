"""The session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tracelake", **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; sizes and masters are left to the cluster."""
    builder = SparkSession.builder.appName(name)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**fixed, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
