"""Schemas of logs and rollups, and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: Fixed values.
LEVELS = ("debug", "info", "warn", "error")
BUCKET_MS = {"1m": 60_000, "5m": 300_000, "1h": 3_600_000, "1d": 86_400_000}
GROUPS = ("service", "level")
MINUTE_MS = 60_000

ATTRIBUTES = T.MapType(T.StringType(), T.StructType().add("kind", "string").add("str", "string").add("num", "double").add("bool", "boolean"))
RECORD = T.StructType().add("ts", "timestamp").add("level", "string").add("service", "string").add("message", "string").add("attributes", ATTRIBUTES)
LOGS = T.StructType([T.StructField("id", T.LongType()), *RECORD.fields, T.StructField("area", T.StringType()), T.StructField("day", T.DateType()), T.StructField("batch_id", T.LongType())])
#: Widths of stored counts.
WIDTHS = ("1m", "1h", "1d")
ROLLUP = T.StructType().add("width", "string").add("bucket", "timestamp").add("service", "string").add("level", "string").add("count", "long").add("area", "string").add("day", "date").add("batch_id", "long")


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the jobs rely on: times are UTC, and of a repeated JSON key the last counts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark
