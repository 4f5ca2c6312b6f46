"""Raw ingest batches: one JSON envelope per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, body): lines keep their raw text; `line` tells lines apart and orders those of a file."""
    return with_lines(_named(spark.read.text(path)))


def stream_envelopes(spark: SparkSession, path: str, max_bytes: int = 256 << 20) -> DataFrame:
    """(file, body) as a stream; `max_bytes` bounds what one micro-batch takes in."""
    return _named(spark.readStream.option("maxBytesPerTrigger", max_bytes).text(path))


def with_lines(envelopes: DataFrame) -> DataFrame:
    return envelopes.withColumn("line", F.monotonically_increasing_id())


def _named(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
