"""Strict ISO-8601 times as epoch milliseconds, and text forms of times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, T, time, optional fraction, optional offset; `\z` and not `$`, which also matches before a last line feed.
SHAPE = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.(\d+))?(?:[Zz]|([+-])(\d{2}):?(\d{2}))?\z"


def parse_millis(text: Column) -> Column:
    """Epoch milliseconds of a time, finer digits cut off; null for any other text and impossible days.

    Without an offset the time is UTC. `24:00:00` is the next midnight. Nothing depends on the
    session's time zone.
    """

    def value(p: Column) -> Column:
        date, clock, fraction, sign, hours, minutes = (F.get(p, F.lit(k)) for k in range(6))
        midnight = clock == "24:00:00"
        local = F.concat(date, F.lit(" "), F.when(midnight, "00:00:00").otherwise(clock)).try_cast("timestamp_ntz")
        ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), local) + F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("int")
        offset = F.when(sign == "", 0).otherwise(F.concat(sign, hours).try_cast("int") * 60 + F.concat(sign, minutes).try_cast("int"))
        right = ((sign == "") | ((hours <= "23") & (minutes <= "59"))) & (~midnight | fraction.rlike(r"^0*\z"))
        return F.when(right, ms + F.when(midnight, 86_400_000).otherwise(0) - offset * 60_000)

    # the parts are cut out once, and only for texts of the right shape
    parts = F.when(text.rlike(SHAPE), F.split(F.regexp_replace(text, SHAPE, "$1|$2|$3|$4|$5|$6"), r"\|"))
    return F.get(F.transform(F.array(parts), value), F.lit(0)).cast("long")


def parse_timestamp(text: Column) -> Column:
    return F.timestamp_millis(parse_millis(text))


def millis_text(ts: Column) -> Column:
    """`YYYY-MM-DDTHH:MM:SS.mmmZ`; the session is in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def seconds_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def floor_millis(ts: Column, size_ms: int) -> Column:
    """The start, in epoch milliseconds, of the span of `size_ms` that holds a time; right before 1970 too."""
    ms = F.unix_millis(ts)
    return ms - F.pmod(ms, F.lit(size_ms))


def bucket_start(ts: Column, size_ms: int) -> Column:
    return F.timestamp_millis(floor_millis(ts, size_ms))
