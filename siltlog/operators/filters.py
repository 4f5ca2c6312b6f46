"""Row filters. Values enter plans as literals only."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltlog.specs import LogFilter

_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?", re.ASCII)


def at_millis(ms: int) -> Column:
    return F.timestamp_millis(F.lit(ms).cast("long"))


def time_range(since_ms: int | None, until_ms: int | None, day: bool = False) -> list[Column]:
    """`since <= ts < until`; with `day`, the same bounds on the partition column, so that files are pruned."""
    found = []
    if since_ms is not None:
        found.append(F.col("ts") >= at_millis(since_ms))
        if day:
            found.append(F.col("day") >= F.to_date(at_millis(since_ms)))
    if until_ms is not None:
        found.append(F.col("ts") < at_millis(until_ms))
        if day:
            found.append(F.col("day") <= F.to_date(at_millis(until_ms)))
    return found


def service_is(value: str) -> Column:
    return F.col("service") == F.lit(value)


def level_is(value: str) -> Column:
    return F.col("level") == F.lit(value)


def message_contains(text: str) -> Column:
    """Without regard to case; every character stands for itself."""
    return F.contains(F.lower("message"), F.lower(F.lit(text)))


def attr_equals(key: str, value: str) -> Column:
    """Equal as text, or as the boolean or number that the value reads as. A missing key never matches."""
    held = F.col("attributes")[F.lit(key)]
    arms = [(held["kind"] == "string") & (held["str"] == F.lit(value))]
    if value in ("true", "false"):
        arms.append((held["kind"] == "boolean") & (held["bool"] == F.lit(value == "true")))
    elif _NUMBER.fullmatch(value) and math.isfinite(float(value)):
        arms.append((held["kind"] == "number") & (held["num"] == F.lit(float(value))))
    return F.coalesce(reduce(Column.__or__, arms), F.lit(False))


def conditions(spec: LogFilter, day: bool = False) -> list[Column]:
    found = time_range(spec.since_ms, spec.until_ms, day)
    found += [service_is(spec.service)] if spec.service is not None else []
    found += [level_is(spec.level)] if spec.level is not None else []
    found += [message_contains(spec.q)] if spec.q is not None else []
    return found + [attr_equals(k, v) for k, v in spec.attributes]


def apply_filters(logs: DataFrame, spec: LogFilter) -> DataFrame:
    """Rows for which all conditions hold; without conditions, all rows."""
    found = conditions(spec, "day" in logs.columns)
    return logs.filter(reduce(Column.__and__, found)) if found else logs
