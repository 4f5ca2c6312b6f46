"""The library's operators over the given tables, with equal SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.functions.timestamps import floor_millis, millis_text, parse_millis, seconds_text
from siltlog.operators import audit, buckets, filters, rollup, search, stored
from siltlog.operators.ids import assign_ids
from siltlog.operators.validate import batch_report, split_batch
from siltlog.schema import prepare
from siltlog.sources.adapters import document_logs, events_logs, lineitem_logs
from siltlog.sources.generate import generate_logs
from siltlog.sources.table import LogTable, expired, list_partitions, route_partition
from siltlog.specs import AggregateSpec, LogFilter, Position, SearchSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: 2024-01-05T00:00:00Z, 2024-01-20T12:34:56.789Z, a range of one cut minute, and today for partitions.
SINCE, UNTIL = 1_704_412_800_000, 1_705_754_096_789
CUT_SINCE, CUT_UNTIL = 1_704_412_810_000, 1_704_412_850_000
TODAY = date(2024, 1, 28)
SHIP_SINCE, SHIP_UNTIL = 852_076_830_500, 946_684_799_999  # 1997-01-01T00:00:30.5Z, 1999-12-31T23:59:59.999Z
BATCH_MS = 1_706_000_000_000

EVENTS = """ev AS (SELECT event_id AS id, date_trunc('millisecond', ts) AS ts,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
  concat('svc-', CAST(user_id % 6 AS VARCHAR)) AS service, concat(event_type, ' by user ', CAST(user_id AS VARCHAR)) AS message,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type AS type, user_id % 2 = 0 AS even FROM events)"""
LINES = """li AS (SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_shipdate AS TIMESTAMP) AS ts,
  CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_returnflag = 'A' THEN 'warn' WHEN l_linestatus = 'O' THEN 'info' ELSE 'debug' END AS level,
  concat('svc-', CAST(l_suppkey % 6 AS VARCHAR)) AS service FROM lineitem)"""
START = "strftime(time_bucket(INTERVAL '{}', ts, TIMESTAMP '2000-01-01'), '%Y-%m-%dT%H:%M:%SZ')"
WIDTH = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}
MS = "epoch_ms(ts)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _counts(name: str, size: str, group: str | None = None, where: str = "TRUE", spec: LogFilter = LogFilter(), table: str = "ev") -> None:
    """A bucket count and its SQL."""
    source = events_logs if table == "ev" else lineitem_logs
    sql = f"""WITH {EVENTS if table == "ev" else LINES} SELECT {START.format(WIDTH[size])} AS start, {group or "CAST(NULL AS VARCHAR)"} AS "group", count(*) AS count
      FROM {table} WHERE {where} GROUP BY 1, 2"""
    query(name, sql)(lambda spark, d: buckets.aggregate_base(source(spark, d), AggregateSpec(spec, size, group)))


for _size in WIDTH:
    _counts(f"bucket_{_size}", _size)
_counts("bucket_by_service", "1h", "service")
_counts("bucket_by_level", "1d", "level")
_counts("bucket_lineitem_by_level", "1d", "level", table="li")
_counts("range_filter", "1h", None, f"{MS} >= {SINCE} AND {MS} < {UNTIL}", LogFilter(SINCE, UNTIL))
_counts("service_level_filter", "1d", "service", f"{MS} >= {SINCE} AND service = 'svc-3' AND level = 'error'", LogFilter(since_ms=SINCE, service="svc-3", level="error"))
_counts("attribute_counts", "1d", "level", "k = 7 OR FALSE", LogFilter(attributes=(("k", "7.0"),)))


def _rows(name: str, where: str, spec: LogFilter) -> None:
    sql = f"WITH {EVENTS} SELECT CAST(id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, level, service, message FROM ev WHERE {where}"
    query(name, sql)(lambda spark, d: search.api_projection(filters.apply_filters(events_logs(spark, d), spec)).drop("attributes"))


_rows("api_projection", "TRUE", LogFilter())
_rows("message_search", "contains(lower(message), lower('PURCHASE by'))", LogFilter(q="PURCHASE by"))
_rows("attr_number", "k = 42", LogFilter(attributes=(("k", "42.0"),)))
_rows("attr_text", "type = 'error'", LogFilter(attributes=(("type", "error"),)))
_rows("attr_boolean", "even", LogFilter(attributes=(("even", "true"),)))
_rows("attr_and", "type = 'view' AND even AND k >= 0 AND k = 3", LogFilter(attributes=(("type", "view"), ("even", "true"), ("k", "3"))))
_rows("range_and_service", f"{MS} >= {SINCE} AND {MS} < {UNTIL} AND service = 'svc-1'", LogFilter(SINCE, UNTIL, service="svc-1"))


@query("message_search_documents", "SELECT doc_id AS id, source AS service FROM documents WHERE contains(lower(text), lower('THE of'))")
def _message_search_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_logs(spark, d).filter(filters.message_contains("THE of")).select("id", "service")


@query("message_search_literal", "SELECT doc_id AS id, source AS service FROM documents WHERE contains(lower(text), 'e%%% ') OR contains(lower(text), '_')")
def _message_search_literal(spark: SparkSession, d: str) -> DataFrame:
    """Per cent signs and underscores stand for themselves."""
    return document_logs(spark, d).filter(filters.message_contains("E%%% ") | filters.message_contains("_")).select("id", "service")


def _page(spec: SearchSpec, where: str) -> tuple[Query, str]:
    sql = f"WITH {EVENTS} SELECT CAST(id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, level, service, message FROM ev WHERE {where} ORDER BY ts DESC, ev.id DESC LIMIT {spec.limit}"
    return lambda spark, d: search.api_projection(search.search_page(events_logs(spark, d), spec)).drop("attributes"), sql


_find, _sql = _page(SearchSpec(LogFilter(level="error"), 100), "level = 'error'")
query("search_page", _sql)(_find)
_find, _sql = _page(SearchSpec(LogFilter(service="svc-2"), 50, Position(UNTIL, 5_000)), f"service = 'svc-2' AND ({MS} < {UNTIL} OR ({MS} = {UNTIL} AND id < 5000))")
query("search_page_after", _sql)(_find)

@query("page_walk", f"WITH {EVENTS} SELECT CAST(id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, level, service, message FROM ev WHERE level = 'info' ORDER BY ts DESC, ev.id DESC LIMIT 50 OFFSET 100")
def _page_walk(spark: SparkSession, d: str) -> DataFrame:
    """The third page, reached from the position that each page before it ends with."""
    logs, spec = events_logs(spark, d), SearchSpec(LogFilter(level="info"), 50)
    for _ in range(2):
        _, position = search.next_position(logs, spec)
        if position is None:
            return search.api_projection(logs.limit(0)).drop("attributes")
        spec = search.following(spec, position)
    return search.api_projection(search.search_page(logs, spec)).drop("attributes")


_ROLLUP = "SELECT strftime(time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '2000-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS bucket, service, level, count(*) AS count FROM {} GROUP BY 1, 2, 3"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", seconds_text(F.col("bucket")))


@query("rollup_1m", f"WITH {EVENTS} {_ROLLUP.format('ev')}")
def _rollup_1m(spark: SparkSession, d: str) -> DataFrame:
    return _shown(rollup.build_rollup(events_logs(spark, d)))


@query("rollup_merge", f"WITH {LINES} {_ROLLUP.format('li')}")
def _rollup_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = lineitem_logs(spark, d)
    return _shown(rollup.merge_rollup(*(rollup.build_rollup(rows.filter(F.col("id") % 3 == k)) for k in range(3))))


@query("rollup_to_1h", f"WITH {EVENTS} SELECT {START.format('1 hour')} AS start, service AS \"group\", count(*) AS count FROM ev WHERE level = 'info' GROUP BY 1, 2")
def _rollup_to_1h(spark: SparkSession, d: str) -> DataFrame:
    return buckets.aggregate_rollup(rollup.build_rollup(events_logs(spark, d)), AggregateSpec(LogFilter(level="info"), "1h", "service"))


def _edges(name: str, table: str, since: int, until: int, size: str, group: str | None, level: str | None = None) -> None:
    source, cte = (events_logs, EVENTS) if table == "ev" else (lineitem_logs, LINES)
    also = f" AND level = '{level}'" if level else ""
    sql = f"""WITH {cte} SELECT {START.format(WIDTH[size])} AS start, {group or "CAST(NULL AS VARCHAR)"} AS "group", count(*) AS count
      FROM {table} WHERE {MS} >= {since} AND {MS} < {until}{also} GROUP BY 1, 2"""
    spec = AggregateSpec(LogFilter(since, until, level=level), size, group)
    query(name, sql)(lambda spark, d: buckets.aggregate(source(spark, d), rollup.build_rollup(source(spark, d)), spec))


_edges("aggregate_edges", "ev", SINCE + 30_500, UNTIL, "1h", "service")
_edges("aggregate_edges_one_minute", "ev", CUT_SINCE, CUT_UNTIL, "5m", None)
_edges("aggregate_edges_level", "ev", SINCE + 1, UNTIL, "1d", "level", "warn")
_edges("aggregate_edges_lineitem", "li", SHIP_SINCE, SHIP_UNTIL, "1d", "level")


@query(
    "audit_rollup",
    f"""WITH {EVENTS}, r AS (SELECT time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '2000-01-01') AS b, service, level, count(*) AS n FROM ev GROUP BY 1, 2, 3)
      SELECT strftime(b, '%Y-%m-%dT%H:%M:%SZ') AS bucket, service, level, n AS expected, CASE WHEN service = 'svc-0' AND level = 'error' THEN 0 ELSE n + 1 END AS found
      FROM r WHERE (service = 'svc-0' AND level = 'error') OR (service = 'svc-1' AND level = 'warn')""",
)
def _audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    logs = events_logs(spark, d)
    right = rollup.build_rollup(logs)
    wrong = right.filter("not (service = 'svc-0' and level = 'error')").withColumn("count", F.when(F.expr("service = 'svc-1' and level = 'warn'"), F.col("count") + 1).otherwise(F.col("count")))
    return audit.audit_rollup(logs, wrong)


@query("audit_ids", f"WITH {LINES} SELECT id, count(*) AS count FROM li GROUP BY id HAVING count(*) > 1")
def _audit_ids(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_ids(lineitem_logs(spark, d))


@query("id_summary", f"WITH {LINES} SELECT count(*) AS total, count(DISTINCT id) AS distinct_ids FROM li")
def _id_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.id_summary(lineitem_logs(spark, d))


_AREA = "CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-18' AND DATE '2024-01-30' THEN 'managed' ELSE 'default' END"


@query("route_partition", f"WITH {EVENTS} SELECT id, {_AREA} AS area, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM ev")
def _route_partition(spark: SparkSession, d: str) -> DataFrame:
    return route_partition(events_logs(spark, d), TODAY, 10, 2).select("id", "area", F.col("day").cast("string").alias("day"))


@query("list_partitions", f"WITH {EVENTS} SELECT {_AREA} AS area, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows FROM ev GROUP BY 1, 2")
def _list_partitions(spark: SparkSession, d: str) -> DataFrame:
    return list_partitions(route_partition(events_logs(spark, d), TODAY, 10, 2))


@query("expired_days", f"WITH {EVENTS} SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM ev WHERE CAST(ts AS DATE) + 1 <= DATE '2024-01-18'")
def _expired_days(spark: SparkSession, d: str) -> DataFrame:
    """The days of the events, one row each, tested as retention tests partition folders."""
    days = route_partition(events_logs(spark, d), TODAY).select("day").distinct()
    return days.filter(expired(F.col("day"), TODAY, 10)).select(F.col("day").cast("string").alias("day"))


@query(
    "generate_logs",
    f"""SELECT o_orderkey AS position, 1700000000000 - 2592000000 + CAST(floor(o_orderkey * 2592000000.0 / 1000000.0) AS BIGINT) AS ms,
      (['debug','info','info','info','warn','error'])[CAST(o_orderkey * 7 % 6 + 1 AS INT)] AS level,
      (['checkout','auth','search','billing','inventory','notifications'])[CAST(o_orderkey * 3 % 6 + 1 AS INT)] AS service,
      (['payment declined','payment accepted','token issued','token expiring','cache miss','upstream timeout','request completed','inventory reserved'])[CAST(o_orderkey * 5 % 8 + 1 AS INT)] AS message,
      CAST(1000 + o_orderkey % 9973 AS VARCHAR) AS user_id, (['eu-west','us-east','ap-south'])[CAST(o_orderkey % 3 + 1 AS INT)] AS region,
      CAST(o_orderkey % 4 AS DOUBLE) AS retries, o_orderkey % 2 = 0 AS cached FROM orders""",
)
def _generate_logs(spark: SparkSession, d: str) -> DataFrame:
    """Positions are the order keys, so that the rows grow with the table."""
    rows = generate_logs(spark.read.parquet(f"{d}/orders.parquet"), 1_000_000, 30, 1_700_000_000_000, "o_orderkey")
    held = [F.col("attributes")[k][part].alias(k) for k, part in (("user_id", "str"), ("region", "str"), ("retries", "num"), ("cached", "bool"))]
    return rows.select("position", F.unix_millis("ts").alias("ms"), "level", "service", "message", *held)


@query("assign_ids", f"SELECT ({BATCH_MS} << 20) + i AS id, {BATCH_MS} + (i >> 20) AS ms FROM (SELECT unnest(range((SELECT count(*) FROM lineitem))) AS i)")
def _assign_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of all rows: gap-free whatever the partitions are."""
    return assign_ids(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey"), BATCH_MS).select("id", F.shiftright("id", 20).alias("ms"))


#: An entry for each rule that can fail, by event_id % 14, and the reason that must come out.
_ENTRIES = {
    0: ("""'{"timestamp": 5, "level": "info", "service": "s", "message": "m"}'""", "timestamp must be a string"),
    1: ("""'{"timestamp": null, "level": "info", "service": "s", "message": "m"}'""", "timestamp is required"),
    2: ("""'{"timestamp": "2199-01-01T00:00:00Z", "level": "info", "service": "s", "message": "m"}'""", "timestamp is more than 5 minutes in the future"),
    3: ("""concat('{"timestamp": "', t, '", "level": 3, "service": "s", "message": "m"}')""", "level must be a string"),
    4: ("""concat('{"timestamp": "', t, '", "service": "s", "message": "m"}')""", "level is required"),
    5: ("""concat('{"timestamp": "', t, '", "level": "info", "service": 1, "message": "m"}')""", "service must be a non-empty string"),
    6: ("""concat('{"timestamp": "', t, '", "level": "info", "message": "m"}')""", "service is required"),
    7: ("""concat('{"timestamp": "', t, '", "level": "info", "service": "s", "message": ""}')""", "message must be a non-empty string"),
    8: ("""concat('{"timestamp": "', t, '", "level": "info", "service": "s"}')""", "message is required"),
    9: ("""concat('{"timestamp": "', t, '", "level": "info", "service": "s", "message": "m", "attributes": []}')""", "attributes must be an object"),
    10: ("""concat('{"timestamp": "', t, '", "level": "info", "service": "s", "message": "m", "attributes": {"x": {}}}')""", "attributes.x must be a string, number or boolean"),
    11: ("""concat('{"timestamp": "', t, '", "level": "info", "service": "s", "message": "m", "attributes": null}')""", "accepted"),
    12: ("""'[1]'""", "entry must be an object"),
}


@query("rejected_by_rule", "SELECT event_id, CASE event_id % 14 " + " ".join(f"WHEN {k} THEN '{reason}'" for k, (_, reason) in _ENTRIES.items()) + " ELSE 'accepted' END AS reason FROM events")
def _rejected_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """An envelope for each event, with an entry that fails one rule."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("t", millis_text(F.col("ts").cast("timestamp")))
    entry = "case event_id % 14 " + " ".join(f"when {k} then {text}" for k, (text, _) in _ENTRIES.items()) + """ else concat('{"timestamp": "', t, '", "level": "info", "service": "s", "message": "m"}') end"""
    rows = split_batch(e.select("event_id", F.concat(F.lit('{"logs": ['), F.expr(entry), F.lit("]}")).alias("body")), 1_900_000_000_000).entries
    return rows.select("event_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


#: How the timestamp query spoils the text of an event's time, by event_id % 12; the SQL says what must come out.
_DAMAGE = {
    1: ("substring(t, 1, 19)", "ms // 1000 * 1000"),
    2: ("concat(substring(t, 1, 23), '+03:00')", "ms - 10800000"),
    3: ("concat(lower(substring(t, 1, 23)), 'z')", "ms"),
    4: ("replace(t, 'T', ' ')", "NULL"),
    5: ("substring(t, 1, 10)", "NULL"),
    6: ("concat(substring(t, 1, 5), '13', substring(t, 8))", "NULL"),
    7: ("concat(substring(t, 1, 23), '999-0130')", "ms + 5400000"),
    8: ("concat(substring(t, 1, 10), 'T24:00:00Z')", "(ms // 86400000 + 1) * 86400000"),
    9: ("concat(t, chr(10))", "NULL"),
    10: ("concat(substring(t, 1, 5), '02-30', substring(t, 11))", "NULL"),
    11: ("concat(substring(t, 1, 11), '25', substring(t, 14))", "NULL"),
}


@query(
    "parse_timestamp",
    "SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {k} THEN {want}" for k, (_, want) in _DAMAGE.items()) + " ELSE ms END AS ms FROM (SELECT event_id, epoch_ms(date_trunc('millisecond', ts)) AS ms FROM events)",
)
def _parse_timestamp(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", millis_text(F.col("ts").cast("timestamp")).alias("t"))
    cases = " ".join(f"when {k} then {text}" for k, (text, _) in _DAMAGE.items())
    return rows.select("event_id", parse_millis(F.expr(f"case event_id % 12 {cases} else t end")).alias("ms"))


#: Event ids that an envelope spans.
PART = 500


def _part() -> Column:
    return F.expr(f"event_id div {PART}").alias("part")


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, part, before): how many entries of a user stand in the envelopes before."""
    sizes = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", _part()).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("user_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("user_id", "part", F.coalesce(before, F.lit(0)).cast("int").alias("before"))


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes of the events of each user, by PART event ids: an entry per event, spoilt by event_id % 9; some are broken whole."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("t", millis_text(F.col("ts").cast("timestamp")))
    cases = {
        1: """'7'""",
        2: """concat('{"timestamp": "', t, '", "level": "ERROR", "service": "s", "message": "m"}')""",
        3: """concat('{"level": "info", "service": "s", "message": "m", "id": ', event_id, '}')""",
        4: """concat('{"timestamp": "', t, '", "level": "info", "service": "", "message": "m"}')""",
        5: """concat('{"timestamp": "', t, '", "level": "info", "service": "s", "message": 5}')""",
        6: """concat('{"timestamp": "', t, '", "level": "info", "service": "s", "message": "m", "attributes": {"z": 1, "b": [], "a": null}}')""",
        7: """concat('{"timestamp": "x', t, '", "level": "info", "service": "s", "message": "m"}')""",
    }
    entry = "case event_id % 9 " + " ".join(f"when {k} then {v}" for k, v in cases.items()) + """ else concat('{"timestamp": "', t, '", "level": "info", "service": "s", "message": "m", "attributes": {"k": true}}') end"""
    body = F.concat(F.lit('{"logs": ['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.expr(entry).alias("entry")))), lambda x: x["entry"]), ", "), F.lit("]}"))
    made = e.groupBy("user_id", _part()).agg(body.alias("whole"))
    broken = F.when(F.col("user_id") % 10 == 1, F.concat("whole", F.lit(" x"))).when(F.col("user_id") % 10 == 2, F.lit('{"logs": []}')).when(F.col("user_id") % 10 == 3, F.lit('{"logs": 1}')).when(F.col("user_id") % 10 == 4, F.lit("[1]"))
    return made.select("user_id", "part", F.coalesce(broken, "whole").alias("body"))


@query(
    "validate_report",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, CASE event_id % 9 WHEN 1 THEN 'entry must be an object'
      WHEN 2 THEN 'invalid level: ''ERROR''' WHEN 3 THEN 'timestamp is required' WHEN 4 THEN 'service must be a non-empty string' WHEN 5 THEN 'message must be a non-empty string'
      WHEN 6 THEN 'attributes.b must be a string, number or boolean' WHEN 7 THEN 'invalid timestamp: ''x' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '''' END AS reason FROM events),
    r AS (SELECT user_id, count(*) FILTER (WHERE reason IS NULL) AS accepted, coalesce(string_agg(CAST(k AS VARCHAR) || ' ' || reason, '; ' ORDER BY k) FILTER (WHERE reason IS NOT NULL), '') AS rejected FROM e GROUP BY user_id)
    SELECT user_id, CASE WHEN user_id % 10 IN (1, 2, 3, 4) THEN 0 ELSE accepted END AS accepted, CASE WHEN user_id % 10 IN (1, 2, 3, 4) THEN '' ELSE rejected END AS rejected,
      CASE user_id % 10 WHEN 1 THEN 'malformed JSON body' WHEN 2 THEN 'logs must not be empty' WHEN 3 THEN 'logs must be an array' WHEN 4 THEN 'body must be a JSON object'
      ELSE CASE WHEN accepted > 0 THEN 'ok' ELSE 'all entries were rejected' END END AS outcome FROM r""",
)
def _validate_report(spark: SparkSession, d: str) -> DataFrame:
    """A report per envelope, and from these the line of each user that the SQL asks for."""
    envelopes = _envelopes(spark, d).select(F.struct("user_id", "part").alias("envelope"), "body")
    report = batch_report(split_batch(envelopes, 1_900_000_000_000), "envelope").select("envelope.*", "accepted", "rejected", "outcome").join(_offsets(spark, d), ["user_id", "part"])
    text = F.array_join(F.transform("rejected", lambda r: F.concat((r["index"] + F.col("before")).cast("string"), F.lit(" "), r["reason"])), "; ")
    parts = F.array_sort(F.collect_list(F.when(text != "", F.struct("part", text.alias("text")))))
    failed = F.max(F.when(~F.col("outcome").isin("ok", "all entries were rejected"), F.col("outcome")))
    outcome = F.coalesce(failed, F.when(F.sum("accepted") > 0, "ok").otherwise("all entries were rejected"))
    return report.groupBy("user_id").agg(F.sum("accepted").alias("accepted"), F.array_join(F.transform(parts, lambda p: p["text"]), "; ").alias("rejected"), outcome.alias("outcome"))


@query(
    "validated_records",
    """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS index, epoch_ms(date_trunc('millisecond', ts)) AS ms, event_id % 9 AS kind FROM events WHERE user_id % 10 NOT IN (1, 2, 3, 4)
      QUALIFY event_id % 9 IN (0, 8)""",
)
def _validated_records(spark: SparkSession, d: str) -> DataFrame:
    batch = split_batch(_envelopes(spark, d), 1_900_000_000_000)
    order = spark.read.parquet(f"{d}/events.parquet").select("user_id", _part(), "event_id", F.expr(f"row_number() over (partition by user_id, event_id div {PART} order by event_id) - 1").alias("index"))
    rows = batch.accepted().join(order, ["user_id", "part", "index"]).join(_offsets(spark, d), ["user_id", "part"])
    return rows.select("user_id", (F.col("index") + F.col("before")).alias("index"), F.unix_millis("ts").alias("ms"), (F.col("event_id") % 9).alias("kind"))


@query(
    "typed_attributes",
    """SELECT event_id, epoch_ms(date_trunc('millisecond', ts)) AS ms, 'number' AS n_kind, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS n, 'string' AS t_kind, event_type AS t,
      'boolean' AS b_kind, user_id % 2 = 0 AS b, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 3 END AS size FROM events""",
)
def _typed_attributes(spark: SparkSession, d: str) -> DataFrame:
    """An envelope for each event; every third entry has one attribute more, a text that looks like a number."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("time", millis_text(F.col("ts").cast("timestamp")))
    body = F.expr("""concat('{"logs": [{"timestamp": "', time, '", "level": "info", "service": "s", "message": "m", "attributes": {"n": ', get_json_object(props, '$.k'), ', "t": "', event_type,
      '", "b": ', cast(user_id % 2 = 0 as string), if(event_id % 3 = 0, ', "x": "1"', ''), '}}]}')""")
    rows = split_batch(e.select("event_id", body.alias("body")), 1_900_000_000_000).accepted()
    held = F.col("attributes")
    parts = [c for k, part in (("n", "num"), ("t", "str"), ("b", "bool")) for c in (held[k]["kind"].alias(f"{k}_kind"), held[k][part].alias(k))]
    return rows.select("event_id", F.unix_millis("ts").alias("ms"), *parts, F.size(held).alias("size"))


@query("day_floor", f"WITH {LINES} SELECT CAST(epoch_ms(date_trunc('month', ts)) AS BIGINT) AS month_ms, count(*) AS count, sum(CASE WHEN epoch_ms(ts) % 86400000 = 0 THEN 1 ELSE 0 END) AS midnight FROM li GROUP BY 1")
def _day_floor(spark: SparkSession, d: str) -> DataFrame:
    rows = lineitem_logs(spark, d)
    at_midnight = F.unix_millis("ts") == floor_millis(F.col("ts"), 86_400_000)
    return rows.groupBy(F.unix_millis(F.date_trunc("month", "ts")).alias("month_ms")).agg(F.count("*").alias("count"), F.count_if(at_midnight).alias("midnight"))


def _table(spark: SparkSession, d: str) -> LogTable:
    """A table with the events in two batches, in a folder of its own."""
    from siltlog.sources.scratch import scratch_path

    table = LogTable(spark, scratch_path(spark, "log-table"))
    rows = events_logs(spark, d)
    for k in range(2):
        table.append_logs(rows.filter(F.col("id") % 2 == k), k, TODAY, 10, 2)
    return table


_STORED = f"WITH {EVENTS} SELECT {_AREA} AS area, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, level, count(*) AS rows FROM ev"


def _stored(table: LogTable) -> DataFrame:
    return table.read_logs().groupBy("area", F.col("day").cast("string").alias("day"), "level").agg(F.count("*").alias("rows"))


@query("table_round_trip", f"{_STORED} GROUP BY 1, 2, 3")
def _table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _stored(_table(spark, d))


_TABLES: dict[tuple[str, str], LogTable] = {}


def _kept(spark: SparkSession, d: str) -> LogTable:
    """The table with folded counts, written once for a session; queries only read it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TABLES:
        table = _table(spark, d)
        table.compact_rollup()
        _TABLES[key] = table
    return _TABLES[key]


@query("aggregate_stored", f"""WITH {EVENTS} SELECT {START.format('1 hour')} AS start, service AS "group", count(*) AS count FROM ev WHERE {MS} >= {SINCE + 30_500} AND {MS} < {UNTIL} GROUP BY 1, 2""")
def _aggregate_stored(spark: SparkSession, d: str) -> DataFrame:
    """Whole hours and minutes from the table's own counts, cut minutes from its rows."""
    return stored.aggregate_stored(_kept(spark, d).snapshot(), AggregateSpec(LogFilter(SINCE + 30_500, UNTIL), "1h", "service"))


@query("aggregate_stored_days", f"""WITH {EVENTS} SELECT {START.format('1 day')} AS start, level AS "group", count(*) AS count FROM ev WHERE {MS} >= {SINCE - 1} AND {MS} < {UNTIL} AND service = 'svc-4' GROUP BY 1, 2""")
def _aggregate_stored_days(spark: SparkSession, d: str) -> DataFrame:
    """Days from day counts, the last one from hours, minutes and rows."""
    return stored.aggregate_stored(_kept(spark, d).snapshot(), AggregateSpec(LogFilter(SINCE - 1, UNTIL, service="svc-4"), "1d", "level"))


_SHOWN = f"WITH {EVENTS} SELECT CAST(id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, level, service, message FROM ev WHERE"


@query("page_walk_stored", f"{_SHOWN} level = 'info' AND {MS} < {UNTIL} ORDER BY ts DESC, ev.id DESC LIMIT 50 OFFSET 100")
def _page_walk_stored(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a stored table; the counts choose the days that are read."""
    seen, spec = _kept(spark, d).snapshot(), SearchSpec(LogFilter(until_ms=UNTIL, level="info"), 50)
    for _ in range(2):
        _, position = stored.stored_position(seen, spec)
        if position is None:
            return search.api_projection(seen.logs().limit(0)).drop("attributes")
        spec = search.following(spec, position)
    return search.api_projection(stored.stored_page(seen, spec)).drop("attributes")


@query("search_stored_text", f"{_SHOWN} contains(lower(message), 'purchase by user 1') AND even AND service = 'svc-2' ORDER BY ts DESC, ev.id DESC LIMIT 40")
def _search_stored_text(spark: SparkSession, d: str) -> DataFrame:
    """Text and attributes, which the counts do not know: more days are read while the page is short."""
    spec = SearchSpec(LogFilter(service="svc-2", q="PURCHASE by user 1", attributes=(("even", "true"),)), 40)
    return search.api_projection(stored.stored_page(_kept(spark, d).snapshot(), spec)).drop("attributes")


@query("point_lookup_stored", f"{_SHOWN} type = 'error' AND k = 42 AND service = 'svc-3'")
def _point_lookup_stored(spark: SparkSession, d: str) -> DataFrame:
    """A service and attributes of a stored table, whose files have Bloom filters on them."""
    rows = filters.apply_filters(_kept(spark, d).read_logs(), LogFilter(service="svc-3", attributes=(("type", "error"), ("k", "42"))))
    return search.api_projection(rows).drop("attributes")


class _Interrupted(LogTable):
    """A table that calls `meanwhile` once, when folded counts are written and their commit is not."""

    meanwhile: Callable[[], object] | None = None

    def _advance(self, seen, **changes) -> bool:
        call, self.meanwhile = self.meanwhile, None
        if call:
            call()
        return super()._advance(seen, **changes)


@query("table_compacted_while_written", f"WITH {EVENTS} {_ROLLUP.format('ev')}")
def _table_compacted_while_written(spark: SparkSession, d: str) -> DataFrame:
    """A third batch is committed and days are adopted in the middle of a compaction; all counts are there once."""
    from siltlog.sources.scratch import scratch_path

    table, rows = _Interrupted(spark, scratch_path(spark, "log-table")), events_logs(spark, d)
    for k in range(2):
        table.append_logs(rows.filter(F.col("id") % 3 == k), k, TODAY, 10, 2)

    def meanwhile() -> None:
        other = LogTable(spark, table.root)
        other.append_logs(rows.filter(F.col("id") % 3 == 2), 2, TODAY, 10, 2)
        other.adopt_default(TODAY, 60, 60)

    table.meanwhile = meanwhile
    table.compact_rollup()
    return _shown(rollup.merge_rollup(table.read_rollup()))


@query(
    "audit_stored",
    f"""WITH {EVENTS}, r AS (SELECT time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '2000-01-01') AS b, service, level, count(*) AS n, count(*) FILTER (WHERE id % 2 = 0) AS even_ids FROM ev WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1, 2, 3)
      SELECT strftime(b, '%Y-%m-%dT%H:%M:%SZ') AS bucket, service, level, n AS expected, even_ids AS found FROM r WHERE n <> even_ids""",
)
def _audit_stored(spark: SparkSession, d: str) -> DataFrame:
    """The counts of one day and batch are lost; digests of the commits find the day, and only it is counted again."""
    table = _table(spark, d)
    for area in ("managed", "default"):
        table.files.delete(f"rollup/width=1m/area={area}/day=2024-01-10/batch_id=1")
    return audit.audit_table(table, deep=False)


@query("audit_ids_planted", "SELECT event_id AS id, CASE WHEN event_id % 1000 = 0 THEN 3 ELSE 2 END AS count FROM events WHERE event_id % 1000 = 0 OR event_id % 1500 = 7")
def _audit_ids_planted(spark: SparkSession, d: str) -> DataFrame:
    """Unique ids with some that come again, within a part of the rows and across parts."""
    rows = events_logs(spark, d).select("id")
    twice = rows.filter("id % 1000 = 0")
    return audit.audit_ids(rows.unionByName(twice).unionByName(twice).unionByName(rows.filter("id % 1500 = 7")))


@query("table_replayed", f"WITH {EVENTS} SELECT 'managed' AS area, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, level, count(*) AS rows FROM ev GROUP BY 1, 2, 3")
def _table_replayed(spark: SparkSession, d: str) -> DataFrame:
    """A wider window adopts all days; then both batches come again, and change nothing."""
    table = _table(spark, d)
    table.adopt_default(TODAY, 60, 60)
    for k in range(2):
        table.append_logs(events_logs(spark, d).filter(F.col("id") % 2 == k), k, TODAY, 10, 2)
    return _stored(table)


@query("rollup_after_purge", f"""WITH {EVENTS} SELECT CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-02-01' THEN 'managed' ELSE 'default' END AS area,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS day, level, count(*) AS rows FROM ev WHERE CAST(ts AS DATE) NOT IN (DATE '2024-01-18', DATE '2024-01-19') GROUP BY 1, 2, 3""")
def _rollup_after_purge(spark: SparkSession, d: str) -> DataFrame:
    """The counts that are left after maintenance two days later."""
    table = _table(spark, d)
    table.maintain(date(2024, 1, 30), 10, 2)
    return table.read_rollup().groupBy("area", F.col("day").cast("string").alias("day"), "level").agg(F.sum("count").alias("rows"))


@query("table_compacted_rollup", f"WITH {EVENTS} {_ROLLUP.format('ev')}")
def _table_compacted_rollup(spark: SparkSession, d: str) -> DataFrame:
    table = _table(spark, d)
    table.compact_rollup()
    return _shown(table.read_rollup().select("bucket", "service", "level", "count"))


@query("table_after_maintenance", f"WITH {EVENTS} SELECT CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-02-01' THEN 'managed' ELSE 'default' END AS area, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, level, count(*) AS rows FROM ev WHERE CAST(ts AS DATE) NOT IN (DATE '2024-01-18', DATE '2024-01-19') GROUP BY 1, 2, 3")
def _table_after_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Two days later: days that come into the window are adopted, managed days that fall out are dropped."""
    table = _table(spark, d)
    table.maintain(date(2024, 1, 30), 10, 2)
    return _stored(table)


@query("read_envelopes", "SELECT count(*) FILTER (WHERE event_id % 9 IN (0, 8)) AS rows, count(*) FILTER (WHERE event_id % 9 NOT IN (0, 8)) AS rejected FROM events WHERE user_id % 10 NOT IN (1, 2, 3, 4)")
def _read_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """The envelopes of the events as text files, read in one go; lines are told apart by file and number."""
    from siltlog.sources.envelopes import read_envelopes
    from siltlog.sources.scratch import scratch_path

    source = scratch_path(spark, "envelopes")
    _envelopes(spark, d).select("body").write.text(source)
    report = batch_report(split_batch(read_envelopes(spark, source).select(F.struct("file", "line").alias("envelope"), "body"), 1_900_000_000_000), "envelope")
    return report.agg(F.sum("accepted").alias("rows"), F.sum(F.size("rejected").cast("long")).alias("rejected"))


@query("stream_ingest", "SELECT count(*) FILTER (WHERE event_id % 9 IN (0, 8)) AS rows, count(*) FILTER (WHERE event_id % 9 NOT IN (0, 8)) AS rejected FROM events WHERE user_id % 10 NOT IN (1, 2, 3, 4)")
def _stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The envelopes of the events as text files, taken in by a stream, and the sums of its metrics."""
    from siltlog.sources.scratch import scratch_path
    from siltlog.streaming.ingest import ingest_metrics, stream_ingest

    source, root, checkpoint = (scratch_path(spark, n) for n in ("envelopes", "stream-table", "stream-checkpoint"))
    _envelopes(spark, d).select("body").write.text(source)
    stream_ingest(spark, source, root, checkpoint, now_ms=1_900_000_000_000).awaitTermination()
    return ingest_metrics(LogTable(spark, root)).agg(F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"))


@query("bounded_intake", "SELECT count(*) FILTER (WHERE event_id % 9 IN (0, 8)) AS rows, count(*) FILTER (WHERE event_id % 9 NOT IN (0, 8)) AS rejected, TRUE AS in_five, TRUE AS bounded FROM events WHERE user_id % 10 NOT IN (1, 2, 3, 4)")
def _bounded_intake(spark: SparkSession, d: str) -> DataFrame:
    """All envelopes as one file, committed in flushes of a sixth of its bytes; no flush is larger but for its last line."""
    from siltlog.sources.scratch import scratch_path
    from siltlog.streaming.ingest import ingest_metrics, stream_ingest

    source, root, checkpoint = (scratch_path(spark, n) for n in ("envelopes", "stream-table", "stream-checkpoint"))
    bodies = _envelopes(spark, d).select("body")
    size = bodies.agg(F.sum(F.octet_length("body")).alias("all"), F.max(F.octet_length("body")).alias("longest")).first()
    bodies.coalesce(1).write.text(source)
    stream_ingest(spark, source, root, checkpoint, max_bytes=size["all"] // 6 + 1, now_ms=1_900_000_000_000).awaitTermination()
    bounded = F.max("bytes") <= size["all"] // 6 + 1 + size["longest"]
    return ingest_metrics(LogTable(spark, root)).agg(F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"), (F.count("*") >= 5).alias("in_five"), bounded.alias("bounded"))
