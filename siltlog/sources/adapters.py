"""Other tables seen as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events`: unique (ts, id); the attribute `k` comes from props."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").when(F.col("event_type") == "view", "debug").otherwise("info")
    number = F.get_json_object("props", "$.k").cast("double")
    none = F.lit(None)
    held = F.create_map(
        F.lit("k"), F.struct(F.lit("number").alias("kind"), none.cast("string").alias("str"), number.alias("num"), none.cast("boolean").alias("bool")),
        F.lit("type"), F.struct(F.lit("string").alias("kind"), F.col("event_type").alias("str"), none.cast("double").alias("num"), none.cast("boolean").alias("bool")),
        F.lit("even"), F.struct(F.lit("boolean").alias("kind"), none.cast("string").alias("str"), none.cast("double").alias("num"), (F.col("user_id") % 2 == 0).alias("bool")),
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp")).alias("ts"),
        level.alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 6).cast("string")).alias("service"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        held.alias("attributes"),
    )


def lineitem_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem`: large, with many equal times; its id is not unique, so it is for counts."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    level = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warn").when(F.col("l_linestatus") == "O", "info").otherwise("debug")
    return rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        level.alias("level"),
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 6).cast("string")).alias("service"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" qty "), F.col("l_quantity").cast("int").cast("string")).alias("message"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as messages: language and source stand in for level and service."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("service"), F.col("text").alias("message"))
