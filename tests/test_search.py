from datetime import UTC, datetime, timedelta

import pytest

from siltlog.operators.buckets import aggregate, aggregate_base, aggregate_rollup, can_use_rollup
from siltlog.operators.filters import apply_filters
from siltlog.operators.rollup import build_rollup
from siltlog.operators.search import api_projection, following, next_position, next_token
from siltlog.schema import ATTRIBUTES
from siltlog.specs import AggregateSpec, LogFilter, Position, SearchSpec, aggregate_spec, decode_token, encode_token, millis, search_spec

BASE = datetime(2026, 7, 20, 14, tzinfo=UTC)
MS = int(BASE.timestamp() * 1000)


def attrs(**values):
    kinds = {str: "string", int: "number", float: "number", bool: "boolean"}
    return {k: (kinds[type(v)], v if isinstance(v, str) else None, float(v) if type(v) in (int, float) else None, v if isinstance(v, bool) else None) for k, v in values.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, ts, *rest) for i, (ts, *rest) in enumerate(rows, 1)], "id long, ts timestamp, level string, service string, message string, attributes " + ATTRIBUTES.simpleString())


@pytest.fixture(scope="module")
def five(spark):
    m = lambda n: BASE + timedelta(minutes=n)
    return frame(spark, [
        (m(0), "error", "checkout", "payment declined", attrs(region="eu-west", retries=3)),
        (m(1), "info", "checkout", "payment accepted", attrs(region="us-east", retries=0)),
        (m(2), "warn", "auth", "token expiring SOON", attrs(cached=True)),
        (m(65), "error", "auth", "token rejected", attrs(region="eu-west")),
        (m(70), "debug", "checkout", "cache warm", {}),
    ]).cache()


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        (LogFilter(), {1, 2, 3, 4, 5}), (LogFilter(service="auth"), {3, 4}), (LogFilter(level="error"), {1, 4}), (LogFilter(MS, MS + 120_000), {1, 2}),
        (LogFilter(MS, MS), set()), (LogFilter(q="soon"), {3}), (LogFilter(q="%"), set()), (LogFilter(attributes=(("region", "eu-west"),)), {1, 4}),
        (LogFilter(attributes=(("retries", "3"),)), {1}), (LogFilter(attributes=(("retries", "3.0"),)), {1}), (LogFilter(attributes=(("retries", "03"),)), set()), (LogFilter(attributes=(("retries", "-0"),)), {2}),
        (LogFilter(attributes=(("cached", "true"),)), {3}), (LogFilter(attributes=(("region", "eu-west"), ("retries", "3"))), {1}), (LogFilter(attributes=(("none'--", "x"),)), set()), (LogFilter(service="' OR 1=1 --"), set()),
    ],
)
def test_filters(five, spec, want):
    assert set(ids(apply_filters(five, spec))) == want


def test_stored_text_is_not_a_number(spark):
    rows = frame(spark, [(BASE, "info", "s", "m", attrs(n="3.0", e="")), (BASE, "info", "s", "m", attrs(n=3))])
    assert ids(apply_filters(rows, LogFilter(attributes=(("n", "3"),)))) == [2]
    assert set(ids(apply_filters(rows, LogFilter(attributes=(("n", "3.0"),))))) == {1, 2}
    assert ids(apply_filters(rows, LogFilter(attributes=(("e", ""),)))) == [1]


def test_literal_search(spark):
    rows = frame(spark, [(BASE, "info", "s", "100% complete", {}), (BASE, "info", "s", "zz", {})])
    assert ids(apply_filters(rows, LogFilter(q="100%"))) == [1] and ids(apply_filters(rows, LogFilter(q="z%z"))) == []


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_pages_walk_every_row_once(five, limit):
    spec, seen = SearchSpec(limit=limit), []
    while True:
        page, position = next_position(five, spec)
        seen += [r["id"] for r in page]
        if position is None:
            break
        assert decode_token(encode_token(position)) == position
        spec = following(spec, position)
    assert seen == [5, 4, 3, 2, 1]


def test_ties_and_full_last_page(spark):
    rows = frame(spark, [(BASE, "info", "s", f"tied {c}", {}) for c in "abcd"])
    spec, seen = SearchSpec(limit=1), []
    for _ in range(4):
        page, position = next_position(rows, spec)
        seen += [r["id"] for r in page]
        spec = following(spec, position) if position else spec
    assert seen == [4, 3, 2, 1] and position is None
    assert next_token(rows, SearchSpec(LogFilter(service="none")))[1] is None


def test_projection(five):
    row = api_projection(five.filter("id = 3")).first()
    assert (row["id"], row["timestamp"], row["level"]) == ("3", "2026-07-20T14:02:00.000Z", "warn")


def test_aggregate(five):
    spec = LogFilter(MS, MS + 7_200_000)
    assert aggregate_base(five, AggregateSpec(spec, "1h")).collect() == [("2026-07-20T14:00:00Z", None, 3), ("2026-07-20T15:00:00Z", None, 2)]
    assert [tuple(r)[1:] for r in aggregate_base(five, AggregateSpec(spec, "1h", "service")).collect()] == [("auth", 1), ("checkout", 2), ("auth", 1), ("checkout", 1)]
    assert aggregate_base(five, AggregateSpec(LogFilter(attributes=(("region", "eu-west"),)), "1d")).collect() == [("2026-07-20T00:00:00Z", None, 2)]
    assert aggregate_base(five, AggregateSpec(LogFilter(), "1m")).count() == 5


@pytest.fixture(scope="module")
def spread(spark):
    levels, services = ["debug", "info", "warn", "error"], ["checkout", "auth", "search"]
    return frame(spark, [(BASE + timedelta(minutes=i % 180, seconds=i % 37), levels[i % 4], services[i % 3], f"entry {i}", attrs(region="eu-west" if i % 2 == 0 else "us-east")) for i in range(600)]).cache()


@pytest.mark.parametrize(("since", "until"), [(30, 10800), (0, 10817), (21, 5443), (10, 50), (0, 10800), (60, 60), (-1, 10)])
@pytest.mark.parametrize(("size", "group"), [("1m", None), ("5m", "level"), ("1h", "service")])
def test_edges_equal_base(spread, since, until, size, group):
    rollup = build_rollup(spread)
    spec = AggregateSpec(LogFilter(MS + since * 1000, MS + until * 1000), size, group)
    assert aggregate(spread, rollup, spec).collect() == aggregate_base(spread, spec).collect()


def test_rollup_use(spread):
    whole = LogFilter(MS, MS + 10_800_000)
    assert can_use_rollup(AggregateSpec(whole, "1h")) and not can_use_rollup(AggregateSpec(LogFilter(MS, MS + 59_999), "1h"))
    assert not can_use_rollup(AggregateSpec(LogFilter(MS, MS + 120_000, q="x"), "1h")) and not can_use_rollup(AggregateSpec(LogFilter(MS), "1h"))
    assert sum(r["count"] for r in aggregate_rollup(build_rollup(spread), AggregateSpec(whole, "1d")).collect()) == 600


def test_minutes_before_1970(spark):
    rows = frame(spark, [(datetime(1969, 12, 31, 23, 59, 30, tzinfo=UTC), "info", "s", "m", {})])
    assert aggregate_base(rows, AggregateSpec(LogFilter(), "1m")).first()["start"] == "1969-12-31T23:59:00Z"


@pytest.mark.parametrize(
    ("params", "message"),
    [
        ({"limit": "ten"}, "limit must be an integer"), ({"limit": "10.5"}, "limit must be an integer"), ({"limit": "-1"}, "limit must be an integer"),
        ({"limit": "0"}, "limit must be between 1 and 1000"), ({"limit": "1001"}, "limit must be between 1 and 1000"), ({"level": "loud"}, "unsupported level: 'loud'"),
        ({"since": "soon"}, "invalid since timestamp"), ({"since": "2026-01-02T00:00:00Z", "until": "2026-01-01T00:00:00Z"}, "until must not be earlier than since"),
        ({"attr.": "x"}, "attribute filter is missing a key"), ({"cursor": "???"}, "invalid cursor"), ({"q": ["a", "b"]}, "q must be given once"),
    ],
)
def test_search_parameters(params, message):
    with pytest.raises(ValueError, match="^" + message.replace("(", r"\(").replace("?", r"\?") + "$"):
        search_spec(params)


def test_parameters_that_are_right():
    spec = search_spec({"limit": "1000", "attr.k": "", "service": "", "cursor": encode_token(Position(MS, 7))})
    assert spec == SearchSpec(LogFilter(attributes=(("k", ""),)), 1000, Position(MS, 7))
    times = {"since": "2026-07-20T14:00:00Z", "until": "2026-07-20T15:00:00+00:00"}
    assert aggregate_spec(times | {"bucket": "5m", "group_by": "level"}) == AggregateSpec(LogFilter(MS, MS + 3_600_000), "5m", "level")
    for params, message in (({}, "since is required"), (times, "bucket is required"), (times | {"bucket": "2m"}, "unsupported bucket: '2m'"), (times | {"bucket": "1m", "group_by": "host"}, "unsupported group_by: 'host'")):
        with pytest.raises(ValueError, match=message):
            aggregate_spec(params)


@pytest.mark.parametrize("text", ["2024-02-29T00:00:00Z", "2000-02-29T00:00:00Z", "2026-02-29T00:00:00Z", "1900-02-29T00:00:00Z", "2026-04-31T00:00:00Z", "1969-12-31T23:59:59.999Z", "2026-01-01T24:00:00Z", "2026-01-01T24:00:01Z", "2026-01-01T00:00:00.5+23:59", "2026-01-01T00:00:00-24:00", "2026-01-01T00:60:00Z", "x", ""])
def test_times_agree(spark, text):
    from pyspark.sql import functions as F

    from siltlog.functions.timestamps import parse_millis

    assert spark.createDataFrame([(text,)], "t string").select(parse_millis(F.col("t"))).first()[0] == millis(text)


def test_tokens_that_are_wrong():
    import base64
    import json

    def token(value):
        return base64.urlsafe_b64encode(json.dumps(value).encode()).decode()

    for bad in ({"v": 2, "t": 1, "i": "1"}, {"v": 1, "t": 1.5, "i": "1"}, {"v": 1, "t": 1, "i": 1}, {"v": 1, "t": 1, "i": "x"}, {"v": 1, "t": 1, "i": "-1"}, {"v": 1, "t": 1, "i": "1" * 23}, [1], None, {"v": True, "t": 1, "i": "1"}):
        assert decode_token(token(bad)) is None
