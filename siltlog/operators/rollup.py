"""Counts per minute, service and level; partial counts are added up when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.functions.timestamps import bucket_start
from siltlog.operators.filters import at_millis, level_is, service_is
from siltlog.schema import BUCKET_MS, MINUTE_MS, WIDTHS
from siltlog.specs import LogFilter

KEY = ["bucket", "service", "level"]


def build_rollup(logs: DataFrame, *extra: str) -> DataFrame:
    """(bucket, service, level, count), also by `extra` columns."""
    return logs.groupBy(bucket_start(F.col("ts"), MINUTE_MS).alias("bucket"), "service", "level", *extra).agg(F.count("*").alias("count"))


def merge_rollup(*parts: DataFrame) -> DataFrame:
    """Partial counts added up by key."""
    rows = parts[0].select(*KEY, "count")
    for more in parts[1:]:
        rows = rows.unionByName(more.select(*KEY, "count"))
    return rows.groupBy(*KEY).agg(F.sum("count").alias("count"))


def widen(rollup: DataFrame, *extra: str) -> DataFrame:
    """Counts by minute with those by hour and by day, told apart by `width`; minutes are added up, rows are not read again."""
    width = F.explode(F.array(*map(F.lit, WIDTHS))).alias("width")
    rows = rollup.select(width, "bucket", "service", "level", "count", *extra)
    start = F.col("bucket")
    for w in WIDTHS[1:]:
        start = F.when(F.col("width") == w, bucket_start(F.col("bucket"), BUCKET_MS[w])).otherwise(start)
    return rows.groupBy("width", start.alias("bucket"), "service", "level", *extra).agg(F.sum("count").alias("count"))


#: Parts of a digest, 20 bits each, so that sums over 2^43 rows stay in 64 bits.
DIGEST_PARTS = 3


def day_digests(rollup: DataFrame, *by: str) -> DataFrame:
    """(day, n, digest), or by other columns: rows that the counts of each day stand for, and a sum over them that no order or division into batches changes.

    Days with equal digests have equal counts by minute, service and level, but for a chance of 2^-60.
    """
    h = F.xxhash64(F.unix_millis("bucket"), F.coalesce("service", F.lit("\x00")), F.coalesce("level", F.lit("\x00")))
    parts = [F.sum(F.col("count") * F.shiftrightunsigned(h, 20 * k).bitwiseAND(F.lit((1 << 20) - 1))) for k in range(DIGEST_PARTS)]
    return rollup.groupBy(*(by or ["day"])).agg(F.sum("count").alias("n"), F.array(*parts).alias("digest"))


def rollup_filters(rollup: DataFrame, spec: LogFilter) -> DataFrame:
    """Minutes that start in the range, by service and level; the partition column is bounded too."""
    rows, day = rollup, "day" in rollup.columns
    if spec.since_ms is not None:
        rows = rows.filter(F.col("bucket") >= at_millis(spec.since_ms))
        rows = rows.filter(F.col("day") >= F.to_date(at_millis(spec.since_ms))) if day else rows
    if spec.until_ms is not None:
        rows = rows.filter(F.col("bucket") < at_millis(spec.until_ms))
        rows = rows.filter(F.col("day") <= F.to_date(at_millis(spec.until_ms))) if day else rows
    rows = rows.filter(service_is(spec.service)) if spec.service is not None else rows
    return rows.filter(level_is(spec.level)) if spec.level is not None else rows
