"""A session with the settings that this library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "postlake", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; further settings by keyword, with dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=wanted).getOrCreate()
