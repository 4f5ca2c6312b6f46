"""Search and counts over a stored table, led by its counts: only days and minutes that can matter are read."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siltlog.functions.timestamps import bucket_start
from siltlog.operators.buckets import _base, _group, _shown, aggregate_base, whole_minutes
from siltlog.operators.filters import at_millis, level_is, service_is
from siltlog.operators.search import search_page
from siltlog.schema import BUCKET_MS, MINUTE_MS
from siltlog.sources.table import Snapshot
from siltlog.specs import AggregateSpec, Position, SearchSpec

DAY_MS = BUCKET_MS["1d"]


def _day(ms: int) -> date:
    return date(1970, 1, 1) + timedelta(days=ms // DAY_MS)


def day_counts(snapshot: Snapshot, spec: SearchSpec) -> list[tuple[date, int]]:
    """Days of the search's range, newest first, with rows of its service and level: of whole days from the day counts, of the newest day from its whole minutes before the end."""
    f = spec.filter
    ends = [ms for ms in (f.until_ms, spec.after.ts_ms if spec.after else None) if ms is not None]
    end = min(ends, default=None)

    def wanted(rows: DataFrame) -> DataFrame:
        rows = rows.filter(service_is(f.service)) if f.service is not None else rows
        rows = rows.filter(level_is(f.level)) if f.level is not None else rows
        return rows.filter(F.col("day") >= F.lit(_day(f.since_ms))) if f.since_ms is not None else rows

    days = wanted(snapshot.rollup("1d"))
    if end is not None:
        last = F.lit(_day(end))
        cut = wanted(snapshot.rollup("1m")).filter((F.col("day") == last) & (F.col("bucket") < at_millis(end // MINUTE_MS * MINUTE_MS)))
        days = days.filter(F.col("day") < last).unionByName(cut)
    found = days.groupBy("day").agg(F.sum("count").alias("n")).collect()
    return sorted(((r["day"], r["n"]) for r in found), reverse=True)


def newest_days(counts: list[tuple[date, int]], need: int) -> date | None:
    """The first day of the shortest run of newest days that holds `need` rows; None if all of them hold fewer."""
    for day, n in counts:
        need -= n
        if need <= 0:
            return day
    return None


def stored_page(snapshot: Snapshot, spec: SearchSpec, extra: int = 0) -> DataFrame:
    """`search_page` over a stored table; days older than the page can reach are not read.

    The counts know services and levels. Where a search also asks for text or attributes, they give
    where to begin, and while that is too little four times as many rows are looked at.
    """
    counts, need = day_counts(snapshot, spec), spec.limit + extra
    logs, want = snapshot.logs(), need
    while True:
        first = newest_days(counts, want)
        if first is None:
            return search_page(logs, spec, extra)
        page = search_page(logs.filter(F.col("day") >= F.lit(first)), spec, extra)
        if not (spec.filter.q or spec.filter.attributes) or page.count() >= need:
            return page
        want *= 4


def stored_position(snapshot: Snapshot, spec: SearchSpec) -> tuple[list[Row], Position | None]:
    """The rows of a page, at most `limit`, and the position after which the next page starts, if rows follow."""
    rows = stored_page(snapshot, spec, extra=1).withColumn("ts_ms", F.unix_millis("ts")).collect()
    page = rows[: spec.limit]
    return page, Position(page[-1]["ts_ms"], page[-1]["id"]) if len(rows) > spec.limit else None


def cover(first: int, end: int, widths: list[str]) -> list[tuple[str, int, int]]:
    """Spans (width, from, to) that make up whole minutes from `first` to `end`: the widest where they fit, narrower ones at their ends."""
    if first >= end:
        return []
    if len(widths) == 1:
        return [(widths[0], first, end)]
    size = BUCKET_MS[widths[0]]
    low, high = -(-first // size) * size, end // size * size
    if low >= high:
        return cover(first, end, widths[1:])
    return [(widths[0], low, high), *cover(first, low, widths[1:]), *cover(high, end, widths[1:])]


def aggregate_stored(snapshot: Snapshot, spec: AggregateSpec) -> DataFrame:
    """Exact counts for any range over a stored table: from day, hour and minute counts, and from rows for the cut minutes at the ends.

    A bucket is never cut by a wider count, so counts by hour serve buckets of an hour or a day.
    """
    inner = whole_minutes(spec)
    if inner is None:
        return aggregate_base(snapshot.logs(), spec)
    first, end = inner
    widths = [w for w in ("1d", "1h", "1m") if BUCKET_MS[w] <= BUCKET_MS[spec.bucket]]
    spans: dict[str, list[Column]] = {}
    for width, low, high in cover(first, end, widths):
        held = (F.col("bucket") >= at_millis(low)) & (F.col("bucket") < at_millis(high))
        spans.setdefault(width, []).append(held & F.col("day").between(F.lit(_day(low)), F.lit(_day(high - 1))))
    parts = []
    for width, held in spans.items():
        rows = snapshot.rollup(width).filter(reduce(Column.__or__, held))
        rows = rows.filter(service_is(spec.filter.service)) if spec.filter.service is not None else rows
        rows = rows.filter(level_is(spec.filter.level)) if spec.filter.level is not None else rows
        parts.append(rows.select(bucket_start(F.col("bucket"), BUCKET_MS[spec.bucket]).alias("bucket"), _group(spec.group_by), "count"))
    for since, until in ((spec.filter.since_ms, first), (end, spec.filter.until_ms)):
        if since < until:  # an aligned end has no cut minute and reads no rows
            parts.append(_base(snapshot.logs(), replace(spec, filter=replace(spec.filter, since_ms=since, until_ms=until))))
    rows = reduce(DataFrame.unionByName, parts)
    return _shown(rows.groupBy("bucket", "group").agg(F.sum("count").alias("count")))
