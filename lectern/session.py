"""Session settings and the rounding that the queries share."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the defaults above; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def rounded(column, digits: int = 6):
    """Scores leave every query rounded, so summation order cannot show."""
    return F.round(column, digits)
