"""Deterministic log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the generator.
LEVELS = ["debug", "info", "info", "info", "warn", "error"]
SERVICES = ["checkout", "auth", "search", "billing", "inventory", "notifications"]
REGIONS = ["eu-west", "us-east", "ap-south"]
MESSAGES = ["payment declined", "payment accepted", "token issued", "token expiring", "cache miss", "upstream timeout", "request completed", "inventory reserved"]


def generate_logs(positions: DataFrame, rows: int, days: int, end_ms: int, position: str = "id") -> DataFrame:
    """A log row for each position (0 to rows - 1), spread evenly over the `days` before `end_ms`."""
    at, span = F.col(position), days * 86_400_000

    def pick(values: list[str], place: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), place % len(values))

    def typed(kind: str, value: Column) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("kind"),
            (value if kind == "string" else none.cast("string")).alias("str"),
            (value if kind == "number" else none.cast("double")).alias("num"),
            (value if kind == "boolean" else none.cast("boolean")).alias("bool"),
        )

    ms = F.lit(end_ms - span) + F.floor(at * F.lit(span) / F.lit(rows)).cast("long")
    attributes = F.create_map(
        F.lit("user_id"), typed("string", (at % 9973 + 1000).cast("string")),
        F.lit("region"), typed("string", pick(REGIONS, at)),
        F.lit("retries"), typed("number", (at % 4).cast("double")),
        F.lit("cached"), typed("boolean", at % 2 == 0),
    )
    return positions.select(
        at.alias("position"), F.timestamp_millis(ms).alias("ts"), pick(LEVELS, at * 7).alias("level"), pick(SERVICES, at * 3).alias("service"), pick(MESSAGES, at * 5).alias("message"), attributes.alias("attributes")
    )


def generated(spark: SparkSession, rows: int, days: int, end_ms: int) -> DataFrame:
    return generate_logs(spark.range(rows), rows, days, end_ms)
