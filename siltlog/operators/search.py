"""Newest-first search in pages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siltlog.functions.timestamps import millis_text
from siltlog.operators.filters import apply_filters, at_millis
from siltlog.specs import Position, SearchSpec, encode_token


def seek_after(position: Position, day: bool = False) -> Column:
    """(ts, id) before the position in newest-first order."""
    at = at_millis(position.ts_ms)
    after = (F.col("ts") < at) | ((F.col("ts") == at) & (F.col("id") < F.lit(position.id)))
    return after & (F.col("day") <= F.to_date(at)) if day else after


def search_page(logs: DataFrame, spec: SearchSpec, extra: int = 0) -> DataFrame:
    """The `limit` (+ `extra`) newest matching rows; Spark keeps that many in each task and merges them."""
    rows = apply_filters(logs, spec.filter)
    if spec.after is not None:
        rows = rows.filter(seek_after(spec.after, "day" in logs.columns))
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(spec.limit + extra)


def next_position(logs: DataFrame, spec: SearchSpec) -> tuple[list[Row], Position | None]:
    """The rows of a page, at most `limit`, and the position after which the next page starts, if rows follow."""
    rows = search_page(logs, spec, extra=1).withColumn("ts_ms", F.unix_millis("ts")).collect()
    page = rows[: spec.limit]
    return page, Position(page[-1]["ts_ms"], page[-1]["id"]) if len(rows) > spec.limit else None


def next_token(logs: DataFrame, spec: SearchSpec) -> tuple[list[Row], str | None]:
    page, position = next_position(logs, spec)
    return page, None if position is None else encode_token(position)


def following(spec: SearchSpec, position: Position) -> SearchSpec:
    return replace(spec, after=position)


def api_projection(logs: DataFrame) -> DataFrame:
    """Rows as they are shown: id and time as text."""
    rest = [c for c in ("attributes",) if c in logs.columns]
    return logs.select(F.col("id").cast("string").alias("id"), millis_text(F.col("ts")).alias("timestamp"), "level", "service", "message", *rest)
