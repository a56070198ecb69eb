"""Session defaults: adaptive plans, UTC, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "kindred", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config(map={**DEFAULTS, **conf})
    return (b.master(master) if master else b).getOrCreate()
