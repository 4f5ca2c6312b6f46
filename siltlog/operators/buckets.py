"""Counts per time bucket, from base rows, from the rollup, or exactly from both."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltlog.functions.timestamps import bucket_start, seconds_text
from siltlog.operators.filters import apply_filters
from siltlog.operators.rollup import rollup_filters
from siltlog.schema import BUCKET_MS, MINUTE_MS
from siltlog.specs import AggregateSpec


def _group(group_by: str | None) -> Column:
    return (F.col(group_by) if group_by else F.lit(None).cast("string")).alias("group")


def _shown(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.asc("bucket"), F.asc_nulls_first("group")).select(seconds_text(F.col("bucket")).alias("start"), "group", "count")


def _base(logs: DataFrame, spec: AggregateSpec) -> DataFrame:
    rows = apply_filters(logs, spec.filter).select(bucket_start(F.col("ts"), BUCKET_MS[spec.bucket]).alias("bucket"), _group(spec.group_by))
    return rows.groupBy("bucket", "group").agg(F.count("*").alias("count"))


def aggregate_base(logs: DataFrame, spec: AggregateSpec) -> DataFrame:
    """(start, group, count) of matching rows, oldest bucket first; buckets without rows are left out."""
    return _shown(_base(logs, spec))


def _from_rollup(rollup: DataFrame, spec: AggregateSpec) -> DataFrame:
    rows = rollup_filters(rollup, spec.filter)
    return rows.groupBy(bucket_start(F.col("bucket"), BUCKET_MS[spec.bucket]).alias("bucket"), _group(spec.group_by)).agg(F.sum("count").alias("count"))


def aggregate_rollup(rollup: DataFrame, spec: AggregateSpec) -> DataFrame:
    """The same from minutes; bounds count by a minute's start, and only service and level can be asked for."""
    return _shown(_from_rollup(rollup, spec))


def whole_minutes(spec: AggregateSpec) -> tuple[int, int] | None:
    """First and end of the whole minutes of a range that the rollup can answer, if there are any."""
    f = spec.filter
    if f.attributes or f.q is not None or f.since_ms is None or f.until_ms is None:
        return None
    first, end = -(-f.since_ms // MINUTE_MS) * MINUTE_MS, f.until_ms // MINUTE_MS * MINUTE_MS
    return (first, end) if first < end else None


def can_use_rollup(spec: AggregateSpec) -> bool:
    return whole_minutes(spec) is not None


def aggregate(logs: DataFrame, rollup: DataFrame, spec: AggregateSpec) -> DataFrame:
    """Exact counts for any range: whole minutes from the rollup, the cut minutes at its ends from base rows."""
    inner = whole_minutes(spec)
    if inner is None:
        return aggregate_base(logs, spec)
    first, end = inner
    parts = _from_rollup(rollup, replace(spec, filter=replace(spec.filter, since_ms=first, until_ms=end)))
    for since, until in ((spec.filter.since_ms, first), (end, spec.filter.until_ms)):
        if since < until:  # an aligned end has no cut minute and reads no base rows
            parts = parts.unionByName(_base(logs, replace(spec, filter=replace(spec.filter, since_ms=since, until_ms=until))))
    return _shown(parts.groupBy("bucket", "group").agg(F.sum("count").alias("count")))
