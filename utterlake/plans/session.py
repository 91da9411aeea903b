"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "utterlake", **conf: str) -> SparkSession:
    """A session with UTC, adaptive plans and, unless set otherwise, all local cores."""
    base = {
        "spark.master": "local[*]",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.appName(name).config(map=base | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
