import json
from datetime import UTC, date, datetime, timedelta

import pytest
from test_search import attrs, frame

from siltlog.operators.audit import audit_rollup, id_summary
from siltlog.operators.ids import assign_ids, next_batch_ms
from siltlog.operators.rollup import merge_rollup
from siltlog.sources.envelopes import read_envelopes
from siltlog.sources.generate import generated
from siltlog.sources.table import LogTable, expired_days
from siltlog.streaming.ingest import ingest_batch, ingest_metrics, stream_ingest

TODAY = date(2026, 7, 20)


def at(days, hour=12):
    return datetime(2026, 7, 20, hour, tzinfo=UTC) + timedelta(days=days)


@pytest.fixture
def table(spark, tmp_path):
    return LogTable(spark, f"file://{tmp_path}/table")


def test_round_trip_and_replay(spark, table):
    text = "tab\tline\nback\\slash\rquote\"' é漢😀"
    rows = frame(spark, [(datetime(1995, 3, 4, 5, 6, 7, 8000, tzinfo=UTC), "info", "a\tb", text, attrs(count=0, ratio=-1.5, on=True, off=False)), (at(0), "warn", "s", "m", {})])
    assert table.append_logs(rows, 3, TODAY) and not table.append_logs(rows, 3, TODAY)
    back = {r["id"]: r for r in table.read_logs().collect()}
    assert len(back) == 2 and back[1]["message"] == text and back[1]["area"] == "default" and back[2]["area"] == "managed"
    assert back[1]["attributes"]["ratio"]["num"] == -1.5 and back[1]["attributes"]["off"]["bool"] is False
    assert audit_rollup(table.read_logs(), table.read_rollup()).count() == 0
    table.append_logs(rows.limit(0), 4, TODAY)
    assert table.read_logs().count() == 2


def test_uncommitted_batches_are_not_seen(spark, table):
    table.append_logs(frame(spark, [(at(0), "info", "s", "m", {})]), 1, TODAY)
    table.append_logs(frame(spark, [(at(0), "info", "s", "n", {})]), 2, TODAY)
    table.files.delete("_batches/2.json")
    assert [r["message"] for r in table.read_logs().collect()] == ["m"] and table.read_rollup().count() == 1


def test_compaction(spark, table):
    for n in range(3):
        table.append_logs(frame(spark, [(at(0), "info", "s", f"m{n}", {})]), n, TODAY)
    assert table.compact_rollup() == 3 and table.read_rollup().count() == 1
    assert merge_rollup(table.read_rollup()).first()["count"] == 3 and table.read_logs().count() == 3
    table.append_logs(frame(spark, [(at(0), "info", "s", "late", {})]), 3, TODAY)
    assert table.compact_rollup() == 2 and table.read_rollup().first()["count"] == 4


def test_maintenance(spark, table):
    rows = frame(spark, [(at(d), "info", "s", f"day {d}", {}) for d in (-40, -30, -1, 0, 40)])
    table.append_logs(rows, 0, TODAY - timedelta(days=20), 30, 2)  # -40 and -30 are managed then, 0 and -1 are not yet
    assert {r["day"]: r["area"] for r in table.list_partitions().collect()} == {"2026-06-10": "managed", "2026-06-20": "managed", "2026-07-19": "default", "2026-07-20": "default", "2026-08-29": "default"}
    done = table.maintain(TODAY)
    assert done == {"adopted": [date(2026, 7, 19), date(2026, 7, 20)], "dropped": [date(2026, 6, 10)]}
    assert {r["day"]: r["area"] for r in table.list_partitions().collect()} == {"2026-06-20": "managed", "2026-07-19": "managed", "2026-07-20": "managed", "2026-08-29": "default"}
    assert audit_rollup(table.read_logs(), table.read_rollup()).count() == 0
    assert table.maintain(TODAY) == {"adopted": [], "dropped": []}
    assert expired_days([TODAY - timedelta(days=30), TODAY - timedelta(days=31)], TODAY, 30) == [TODAY - timedelta(days=31)]


def test_replay_after_adoption(spark, tmp_path, table):
    (tmp_path / "one.json").write_text(json.dumps({"logs": [entry(k) for k in range(3)]}))
    envelopes = read_envelopes(spark, f"file://{tmp_path}/one.json")
    now = int(at(-60).timestamp() * 1000)  # the rows are 60 days ahead of the clock: default area
    first = ingest_batch(table, envelopes.filter("false"), 0, now)
    assert first["rows"] == 0
    table.append_logs(frame(spark, [(at(0), "info", "s", "m", {})] * 3), 1, TODAY - timedelta(days=60))
    assert table.adopt_default(TODAY) == [TODAY]
    assert not table.append_logs(frame(spark, [(at(0), "info", "s", "m", {})] * 3), 1, TODAY - timedelta(days=60))
    assert ingest_batch(table, envelopes, 1, now) == {} and table.read_logs().count() == 3
    assert merge_rollup(table.read_rollup()).first()["count"] == 3


def test_many_batches_are_joined(spark, table, monkeypatch):
    from siltlog.sources import table as module

    monkeypatch.setattr(module, "LISTED", 1)
    test_compaction(spark, table)


def test_files_follow_rows(spark, table, monkeypatch):
    from siltlog.sources import table as module

    monkeypatch.setattr(module, "FILE_ROWS", 40)
    table.append_logs(frame(spark, [(at(-(k % 2)), "info", "s", "m", {}) for k in range(200)]), 0, TODAY)
    files = [table.files.names(f"logs/area=managed/day={TODAY - timedelta(days=k)}/batch_id=0") for k in (0, 1)]
    assert [len(f) for f in files] == [3, 3] and table.read_logs().count() == 200


def test_ids(spark):
    rows = spark.range(0, 1000, 1, 7)
    got = sorted(r["id"] for r in assign_ids(rows.withColumnRenamed("id", "n"), 5).collect())
    assert got == [(5 << 20) + k for k in range(1000)]
    assert next_batch_ms(10, (20 << 20) + 5) == 21 and next_batch_ms(30, (20 << 20) + 5) == 30 and next_batch_ms(7, None) == 7
    assert assign_ids(rows.limit(0).withColumnRenamed("id", "n"), 5).count() == 0


def test_generator(spark):
    rows = generated(spark, 1000, 30, 1_700_000_000_000)
    assert {r[0] for r in rows.select("service").distinct().collect()} == {"checkout", "billing"}
    assert id_summary(rows.withColumnRenamed("position", "id")).first() == (1000, 1000)


def entry(k, **more):
    return {"timestamp": f"2026-07-20T12:00:{k % 60:02d}Z", "level": "info", "service": "s", "message": f"m{k}"} | more


def test_stream(spark, tmp_path, table):
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        logs = [entry(10 * n + k) for k in range(10)] + [entry(0, level="loud")]
        (source / f"{n}.json").write_text(json.dumps({"logs": logs}) + "\n[]\n")
    for _ in range(2):  # the second run finds nothing new
        stream_ingest(spark, f"file://{source}", table.root, f"file://{tmp_path}/ckpt", max_bytes=1, now_ms=int(at(0).timestamp() * 1000)).awaitTermination()
    logs = table.read_logs()
    assert logs.count() == 30 and id_summary(logs).first() == (30, 30)
    sums = ingest_metrics(table).agg({"rows": "sum", "rejected": "sum", "failed_envelopes": "sum"}).first().asDict()
    assert sums == {"sum(rows)": 30, "sum(rejected)": 3, "sum(failed_envelopes)": 3}
    assert audit_rollup(logs, table.read_rollup()).count() == 0


def test_replayed_batch(spark, tmp_path, table):
    (tmp_path / "one.json").write_text(json.dumps({"logs": [entry(k) for k in range(5)]}))
    envelopes = read_envelopes(spark, f"file://{tmp_path}/one.json")
    first = ingest_batch(table, envelopes, 0, 1_784_548_800_000)
    before = sorted((r["id"], r["message"]) for r in table.read_logs().collect())
    assert ingest_batch(table, envelopes, 0, 1_999_999_999_999) == first  # the clock of the first try holds
    assert sorted((r["id"], r["message"]) for r in table.read_logs().collect()) == before
    assert ingest_batch(table, envelopes, 1, 1)["batch_ms"] > first["batch_ms"]
