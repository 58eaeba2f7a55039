"""Session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.jsonGenerator.ignoreNullFields": "false",
}


def build(app: str = "tracewright", **more: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    return b.getOrCreate()
