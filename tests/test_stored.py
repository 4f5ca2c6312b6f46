"""The stored table: commits that meet, stable ids, bounded flushes, and reads that counts lead."""

import json
import os
from dataclasses import replace
from datetime import date, timedelta

import pytest
from test_search import attrs, frame
from test_table import TODAY, at, entry

from siltlog.operators import audit, stored
from siltlog.operators.buckets import aggregate_base
from siltlog.operators.filters import apply_filters
from siltlog.operators.ids import assign_ids
from siltlog.operators.rollup import day_digests, merge_rollup
from siltlog.operators.search import search_page
from siltlog.sources.envelopes import read_envelopes
from siltlog.sources.table import LogTable
from siltlog.specs import AggregateSpec, LogFilter, SearchSpec
from siltlog.streaming import ingest

MS = int(at(0).timestamp() * 1000)
DAY = 86_400_000


@pytest.fixture
def table(spark, tmp_path):
    return LogTable(spark, f"file://{tmp_path}/table")


def files_of(table, *parts):
    top = os.path.join(table.root.removeprefix("file://"), *parts)
    return [os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")]


def week(spark, n=5):
    return frame(spark, [(at(-d, h), "info" if h % 2 else "warn", f"s{h % 3}", f"m{d}", {}) for d in range(n) for h in range(24)])


def test_a_commit_is_written_once(table):
    assert table.files.put("_batches/9.json", {"metrics": {}, "days": {}}) and not table.files.put("_batches/9.json", {"metrics": {"rows": 5}, "days": {}})
    assert table.metrics(9) == {} and table.files.names("_batches") == ["9.json"] and table.metrics(8) is None


@pytest.mark.parametrize("other", ["batch", "adoption", "compaction"])
def test_compaction_beside_other_commits(spark, table, other, monkeypatch):
    for n in range(2):
        table.append_logs(week(spark), n, TODAY - timedelta(days=90))
    calls, plain = [], LogTable._advance

    def advance(self, seen, **changes):
        if not calls:
            calls.append(1)
            beside = LogTable(spark, table.root)
            if other == "batch":
                beside.append_logs(week(spark), 2, TODAY)
            elif other == "adoption":
                beside.adopt_default(TODAY)
            else:
                beside.compact_rollup()
        return plain(self, seen, **changes)

    monkeypatch.setattr(LogTable, "_advance", advance)
    table.compact_rollup()
    batches = 3 if other == "batch" else 2
    assert merge_rollup(table.read_rollup()).groupBy().sum("count").first()[0] == 120 * batches == table.read_logs().count()
    assert audit.audit_table(table).count() == 0 and audit.audit_table(table, deep=False).count() == 0
    for width in ("1h", "1d"):
        assert table.read_rollup(width).groupBy().sum("count").first()[0] == 120 * batches


def test_adoption_moves_nothing(spark, table):
    table.append_logs(week(spark), 0, TODAY - timedelta(days=90))
    before, seen = sorted(files_of(table)), table.snapshot()
    old = seen.logs()
    assert table.adopt_default(TODAY) == [TODAY - timedelta(days=d) for d in (4, 3, 2, 1, 0)] and table.adopt_default(TODAY) == []
    assert sorted(files_of(table)) == before and old.count() == 120
    assert {r["area"] for r in old.select("area").distinct().collect()} == {"default"}
    assert {r["area"] for r in table.read_logs().select("area").distinct().collect()} == {"managed"} == {r["area"] for r in table.read_rollup().select("area").distinct().collect()}
    assert table.days() == table.days("rollup") and table.days("logs", "default") == []


def test_dropping_names_its_folders(spark, table):
    """A batch that comes while days are dropped keeps its rows."""
    table.append_logs(week(spark), 0, TODAY)
    clear = LogTable._clear

    def meanwhile(self, seen):
        if seen.state["gone"] and 1 not in table.batches():
            assert table.read_logs().count() == 48  # out of sight before anything is deleted
            table.append_logs(week(spark), 1, TODAY)
        clear(self, seen)

    LogTable._clear = meanwhile
    try:
        assert table.drop_expired(TODAY, 1) == [TODAY - timedelta(days=d) for d in (4, 3, 2)]
    finally:
        LogTable._clear = clear
    assert table.read_logs().filter("batch_id = 0").count() == 48 and table.read_logs().filter("batch_id = 1").count() == 120
    assert audit.audit_table(table).count() == 0 and audit.audit_table(table, deep=False).count() == 0


def test_ids_survive_another_cut_of_the_files(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    spark.range(0, 50_000, 1, 3).withColumnRenamed("id", "n").write.parquet(path)
    found = []
    for splits in ("2", "16"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", splits)
        try:
            made = assign_ids(spark.read.parquet(path), 5)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16" if splits == "2" else "2")
            rows = {r["n"]: r["id"] for r in made.collect()}
            assert rows == {r["n"]: r["id"] for r in made.collect()}
            found.append(sorted(rows.values()))
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert found[0] == found[1] == [(5 << 20) + k for k in range(50_000)]


def test_one_file_in_flushes(spark, tmp_path, table, monkeypatch):
    lines = [json.dumps({"logs": [entry(10 * n + k) for k in range(10)] + [entry(0, level="loud")]}) for n in range(20)] + ["[]"]
    (tmp_path / "one.json").write_text("\n".join(lines))
    envelopes, bound = read_envelopes(spark, f"file://{tmp_path}/one.json"), sum(map(len, lines)) // 5
    append, made = LogTable.append_logs, []

    def failing(self, *args, **more):
        if len(made) == 3:
            raise OSError("lost")
        made.append(append(self, *args, **more))
        return made[-1]

    monkeypatch.setattr(LogTable, "append_logs", failing)
    with pytest.raises(OSError):
        ingest.ingest_batch(table, envelopes, 7, MS, bound)
    monkeypatch.setattr(LogTable, "append_logs", append)
    first = {r["id"]: r["message"] for r in table.read_logs().collect()}
    whole = ingest.ingest_batch(table, envelopes, 7, MS + 5, bound)  # goes on after the third flush
    assert whole["rows"] == 200 and whole["rejected"] == 20 and whole["failed_envelopes"] == 1 and whole["flushes"] >= 5
    assert ingest.ingest_batch(table, envelopes, 7, MS + 9, bound) == whole
    rows = {r["id"]: r["message"] for r in table.read_logs().collect()}
    assert len(rows) == 200 and len(first) < 200 and first.items() <= rows.items() and sorted(rows.values()) == sorted(f"m{k}" for k in range(200))
    parts = ingest.ingest_metrics(table).collect()
    assert len(parts) == whole["flushes"] and all(r["bytes"] <= bound + max(map(len, lines)) for r in parts) and sum(r["bytes"] for r in parts) == sum(map(len, lines))
    assert not files_of(table, "_staging")


def test_envelopes_are_parsed_once(spark, tmp_path, table):
    (tmp_path / "one.json").write_text(json.dumps({"logs": [entry(1), 2]}) + "\nno\n")
    from siltlog.operators.validate import batch_report, split_batch

    batch = split_batch(read_envelopes(spark, f"file://{tmp_path}/one.json"), MS)
    plan = batch_report(batch, "line")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and plan.count("Generate") == 1
    assert sorted((r["accepted"], len(r["rejected"]), r["outcome"]) for r in batch_report(batch, "line").collect()) == [(0, 0, "malformed JSON body"), (1, 1, "ok")]
    assert batch.failed().count() == 1 and batch.accepted().count() == 1 and batch.rejected().first()["index"] == 1


def test_pages_read_new_days_only(spark, table):
    table.append_logs(week(spark), 0, TODAY)
    table.append_logs(week(spark, 2).selectExpr("id + 1000 as id", "ts", "level", "service", "message", "attributes"), 1, TODAY)
    table.compact_rollup()
    whole = table.read_logs()
    specs = [SearchSpec(LogFilter(), 30), SearchSpec(LogFilter(level="warn", service="s0"), 9), SearchSpec(LogFilter(until_ms=MS - DAY + 12_345), 10), SearchSpec(LogFilter(service="s1", until_ms=MS), 5)]
    want = [[(r["ts"], r["id"], r["batch_id"]) for r in search_page(whole, s).collect()] for s in specs]
    for d in (3, 4):  # whatever reads these days fails
        for path in files_of(table, "logs", "area=managed", f"day={TODAY - timedelta(days=d)}"):
            with open(path, "wb") as f:
                f.write(b"no parquet")
            crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
            if os.path.exists(crc):
                os.remove(crc)
    seen = table.snapshot()
    assert [[(r["ts"], r["id"], r["batch_id"]) for r in stored.stored_page(seen, s).collect()] for s in specs] == want
    assert stored.newest_days([(date(2026, 1, 3), 5), (date(2026, 1, 2), 5)], 6) == date(2026, 1, 2) and stored.newest_days([(date(2026, 1, 3), 5)], 6) is None
    with pytest.raises(Exception):
        stored.stored_page(seen, SearchSpec(LogFilter(), 400)).collect()


def test_stored_pages_of_text(spark, table):
    table.append_logs(week(spark), 0, TODAY)
    seen = table.snapshot()
    for spec in (SearchSpec(LogFilter(q="M4"), 7), SearchSpec(LogFilter(q="m0"), 7), SearchSpec(LogFilter(q="nowhere"), 7), SearchSpec(LogFilter(since_ms=MS - 2 * DAY), 300)):
        assert [r["id"] for r in stored.stored_page(seen, spec).collect()] == [r["id"] for r in search_page(seen.logs(), spec).collect()]
        walked, at_ = [], replace(spec, limit=2)
        for _ in range(3):
            rows, position = stored.stored_position(seen, at_)
            walked += [r["id"] for r in rows]
            if position is None:
                break
            at_ = replace(at_, after=position)
        assert walked == [r["id"] for r in search_page(seen.logs(), replace(spec, limit=6)).collect()]


@pytest.mark.parametrize("folded", [False, True])
def test_counts_of_all_widths(spark, table, folded):
    table.append_logs(week(spark), 0, TODAY)
    table.append_logs(week(spark, 3), 1, TODAY)
    if folded:
        table.compact_rollup()
    seen = table.snapshot()
    for since, until in ((MS - 3 * DAY, MS), (MS - 3 * DAY + 1, MS + 3_599_999), (MS - DAY + 61_000, MS - DAY + 119_000), (MS - 4 * DAY - 12 * 3_600_000, MS + 12 * 3_600_000), (MS, MS)):
        for size in ("1m", "5m", "1h", "1d"):
            spec = AggregateSpec(LogFilter(since, until, service="s1"), size, "level")
            assert stored.aggregate_stored(seen, spec).collect() == aggregate_base(seen.logs(), spec).collect(), (since, until, size)


def test_days_are_counted_from_days(spark, table):
    table.append_logs(week(spark), 0, TODAY)
    table.append_logs(week(spark), 1, TODAY)
    table.compact_rollup()
    start = MS - 12 * 3_600_000
    spec = AggregateSpec(LogFilter(start - 4 * DAY, start + DAY), "1d")
    want = aggregate_base(table.read_logs(), spec).collect()
    for path in [*files_of(table, "logs"), *files_of(table, "rollup", "width=1m"), *files_of(table, "rollup", "width=1h")]:
        os.remove(path)
    assert [r["count"] for r in stored.aggregate_stored(table.snapshot(), spec).collect()] == [r["count"] for r in want] == [48] * 5
    assert stored.cover(61, 10_000_000, ["1m"]) == [("1m", 61, 10_000_000)]
    assert stored.cover(3_540_000, 2 * DAY + 60_000, ["1d", "1h", "1m"]) == [("1d", DAY, 2 * DAY), ("1h", 3_600_000, DAY), ("1m", 3_540_000, 3_600_000), ("1m", 2 * DAY, 2 * DAY + 60_000)]


def test_audit_joins_days_that_differ(spark, table, monkeypatch):
    table.append_logs(week(spark), 0, TODAY)
    bad = table.read_rollup().filter(f"not (day = '{TODAY - timedelta(days=1)}' and service = 's1')")
    asked = []
    plain = audit._compared
    monkeypatch.setattr(audit, "_compared", lambda logs, rollup: asked.append({r[0] for r in logs.select("day").distinct().collect()}) or plain(logs, rollup))
    found = audit.audit_rollup(table.read_logs(), bad).collect()
    assert len(found) == 8 and all(r["found"] == 0 and r["service"] == "s1" for r in found) and asked == [{TODAY - timedelta(days=1)}]
    assert audit.audit_rollup(table.read_logs(), table.read_rollup()).count() == 0 and asked[1] == set()
    parts = table.read_rollup()
    halves = day_digests(parts.withColumn("count", parts["count"] - parts["count"] + 1).unionByName(parts.limit(0)))
    assert audit.differing_days(halves, day_digests(parts)) == []


def test_audit_of_ids(spark):
    rows = spark.range(0, 6000, 1, 6)
    assert audit.audit_ids(rows).count() == 0
    assert audit.crossing([(0, 9), (10, 19), (20, 20)]) == [] and audit.crossing([(0, 9), (9, 12), (11, 30)]) == [(9, 9), (11, 12)] and audit.crossing([(5, 5), (5, 5)]) == [(5, 5)]
    more = rows.unionByName(rows.filter("id in (7, 5999)")).unionByName(spark.createDataFrame([(None,), (None,), (7,), (70_000,), (70_000,)], "id long"))
    assert sorted((str(r["id"]), r["count"]) for r in audit.audit_ids(more).collect()) == [("5999", 2), ("7", 3), ("70000", 2), ("None", 2)]
    assert audit.audit_ids(rows.limit(0)).count() == 0


def test_many_crossing_spans_are_merged(spark, monkeypatch):
    monkeypatch.setattr(audit, "SPANS", 2)
    merged = audit.crossing([(10 * k, 10 * k + 1) for k in range(5)] * 2)
    assert len(merged) == 2 and merged[0][0] == 0 and merged[0][1] < merged[1][0] and merged[1][1] == 41
    rows = spark.createDataFrame([(10 * k + j,) for k in range(5) for j in range(2)] * 2, "id long")
    assert sorted(tuple(r) for r in audit.audit_ids(rows.repartition(3)).collect()) == [(10 * k + j, 2) for k in range(5) for j in range(2)]


def test_point_filters_skip_row_groups(spark, table):
    rows = frame(spark, [(at(0), "info", f"svc-{2 * k:04d}", "m", attrs(host=f"h{2 * k:04d}")) for k in range(2000)])
    table.append_logs(rows.coalesce(1), 0, TODAY)

    def read(spec):
        found = apply_filters(table.read_logs(), spec).select("id")
        out = found.collect()
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return len(out), leaf.metrics().apply("numOutputRows").value()

    assert read(LogFilter(service="svc-0500")) == (1, 2000)
    assert read(LogFilter(service="svc-0501")) == (0, 0)  # between the least and the largest, but in no row group
