"""A session with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "medialake", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; everything else is the cluster's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=own | settings).getOrCreate()
