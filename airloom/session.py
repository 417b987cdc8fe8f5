"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "airloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution, and code generation for the wide window aggregate."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.codegen.maxFields": "1000",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
