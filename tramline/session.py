"""Sessions with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tramline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI errors and adaptive execution; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
