"""Session builder with the settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "prismloom", master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow. Sizes such as shuffle partitions follow
    the cluster through AQE; pass ``conf`` to override any setting."""
    builder = SparkSession.builder.appName(app)
    if master or cores:
        builder = builder.master(master or f"local[{cores}]")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
