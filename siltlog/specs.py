"""Parameters of searches and aggregations, checked when a job is set up."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from siltlog.schema import BUCKET_MS, GROUPS, LEVELS

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
_TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:[Zz]|([+-])(\d\d):?(\d\d))?", re.ASCII)


@dataclass(frozen=True)
class LogFilter:
    """All given conditions must hold; `until_ms` is exclusive."""

    since_ms: int | None = None
    until_ms: int | None = None
    service: str | None = None
    level: str | None = None
    q: str | None = None
    attributes: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Position:
    """The last row of a page: the next one starts after it."""

    ts_ms: int
    id: int


@dataclass(frozen=True)
class SearchSpec:
    filter: LogFilter = LogFilter()
    limit: int = DEFAULT_LIMIT
    after: Position | None = None


@dataclass(frozen=True)
class AggregateSpec:
    filter: LogFilter
    bucket: str
    group_by: str | None = None


def millis(text: str) -> int | None:
    """The driver-side twin of functions.timestamps.parse_millis."""
    m = _TIME.fullmatch(text)
    if not m:
        return None
    year, month, day, hour, minute, second = map(int, m.groups()[:6])
    fraction, sign = m[7] or "", m[8]
    if hour == 24 and minute == second == 0 and not fraction.strip("0"):
        extra, hour = timedelta(days=1), 0
    else:
        extra = timedelta()
    if sign and (int(m[9]) > 23 or int(m[10]) > 59):
        return None
    try:
        at = datetime(year, month, day, hour, minute, second, tzinfo=UTC) + extra
    except (ValueError, OverflowError):
        return None
    offset = timedelta(hours=int(m[9]), minutes=int(m[10])) * (-1 if sign == "-" else 1) if sign else timedelta()
    whole = (at - datetime(1970, 1, 1, tzinfo=UTC)) - offset
    return whole // timedelta(milliseconds=1) + int((fraction + "000")[:3])


class _Reader:
    def __init__(self, params: Mapping[str, object]) -> None:
        self.params = params

    def one(self, key: str) -> str | None:
        value = self.params.get(key)
        if value is not None and not isinstance(value, str):
            raise ValueError(f"{key} must be given once")
        return value or None

    def time(self, key: str) -> int | None:
        text = self.one(key)
        at = None if text is None else millis(text)
        if text is not None and at is None:
            raise ValueError(f"invalid {key} timestamp")
        return at

    def filter(self) -> LogFilter:
        service, level = self.one("service"), self.one("level")
        if level is not None and level not in LEVELS:
            raise ValueError(f"unsupported level: '{level}'")
        since, until = self.time("since"), self.time("until")
        if since is not None and until is not None and until < since:
            raise ValueError("until must not be earlier than since")
        q, attributes = self.one("q"), []
        for name, value in self.params.items():
            if name.startswith("attr."):
                if name == "attr.":
                    raise ValueError("attribute filter is missing a key")
                if not isinstance(value, str):
                    raise ValueError(f"{name} must be given once")
                attributes.append((name.removeprefix("attr."), value))  # an empty value is a value
        return LogFilter(since, until, service, level, q, tuple(attributes))


def search_spec(params: Mapping[str, object]) -> SearchSpec:
    """A search from named texts; raises ValueError with what is wrong. Empty texts count as absent."""
    read = _Reader(params)
    found, text = read.filter(), read.one("limit")
    if text is not None and not re.fullmatch(r"\d+", text, re.ASCII):
        raise ValueError("limit must be an integer")
    limit = DEFAULT_LIMIT if text is None else int(text)
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    token = read.one("cursor")
    after = None if token is None else decode_token(token)
    if token is not None and after is None:
        raise ValueError("invalid cursor")
    return SearchSpec(found, limit, after)


def aggregate_spec(params: Mapping[str, object]) -> AggregateSpec:
    read = _Reader(params)
    found = read.filter()
    for key, value in (("since", found.since_ms), ("until", found.until_ms)):
        if value is None:
            raise ValueError(f"{key} is required")
    bucket = read.one("bucket")
    if bucket is None:
        raise ValueError("bucket is required")
    if bucket not in BUCKET_MS:
        raise ValueError(f"unsupported bucket: '{bucket}'")
    group = read.one("group_by")
    if group is not None and group not in GROUPS:
        raise ValueError(f"unsupported group_by: '{group}'")
    return AggregateSpec(found, bucket, group)


def encode_token(position: Position) -> str:
    body = json.dumps({"v": 1, "t": position.ts_ms, "i": str(position.id)}, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_token(token: str) -> Position | None:
    """The position of a token, or None if anything about it is not as encoded."""
    try:
        found = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except ValueError:
        return None
    if not isinstance(found, dict) or type(found.get("v")) is not int or found["v"] != 1:
        return None
    at, row = found.get("t"), found.get("i")
    if isinstance(at, float) and at.is_integer():
        at = int(at)
    if type(at) is not int or not isinstance(row, str) or not re.fullmatch(r"\d{1,19}", row, re.ASCII):
        return None
    return Position(at, int(row))
