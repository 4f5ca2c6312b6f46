"""Shared scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.sources.scratch import scratch_path


#: Parts that the rows of one group are dealt to where both sides of `join_group` are shuffled.
SALTS = 16


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (`spark.checkpoint.dir`)."""
    return scratch_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_group(rows: DataFrame, groups: DataFrame, on: Column, limit: int, spread: Column) -> DataFrame:
    """Each of `rows` with what `groups` holds of it, or nulls; `groups` has at most one row that fits by `on`.

    Up to `limit` groups are sent to every executor. Above it both sides are shuffled: rows of one group
    are dealt to SALTS parts by the number `spread`, which must be the same on each reading, and each part
    has a copy of the group, so no task has all rows of a hot one.
    """
    if groups.count() <= limit:
        return rows.join(F.broadcast(groups), on, "left")
    rows = rows.withColumn("__salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    groups = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(groups, on & (F.col("__salt") == F.col("__part")), "left").drop("__salt", "__part")
