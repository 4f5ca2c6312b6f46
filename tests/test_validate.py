import json

import pytest

from siltlog.operators.validate import batch_report, split_batch
from siltlog.specs import millis

NOW = millis("2026-07-20T14:32:01.000Z")
GOOD = {"timestamp": "2026-07-20T14:32:01.123Z", "level": "error", "service": "checkout", "message": "payment declined"}


def spoilt(**changes):
    out = dict(GOOD)
    for k, v in changes.items():
        out.pop(k, None) if v is KeyError else out.update({k: v})
    return out


CASES = [
    (None, "entry must be an object"), ([], "entry must be an object"), ("log", "entry must be an object"), (7, "entry must be an object"),
    (spoilt(timestamp=KeyError), "timestamp is required"), (spoilt(timestamp=None), "timestamp is required"), (spoilt(timestamp=5), "timestamp must be a string"),
    *[(spoilt(timestamp=t), f"invalid timestamp: '{t}'") for t in ("March 5 2020", "2026-07-20", "2026-07-20 14:32:01Z", "", "2026-13-01T00:00:00Z", "2026-02-30T00:00:00Z", "2026-07-20T14:32:01Z\n")],
    *[(spoilt(timestamp=t), None) for t in ("2026-07-20T17:32:01+03:00", "2026-07-20T14:32:01", "2026-07-20T14:32:01.123456Z", "2019-01-01T00:00:00Z", "2026-07-20T14:37:01.000Z", "2026-07-20t14:32:01z", "2026-07-20T16:32:01+0300", "2026-07-19T24:00:00Z")],
    (spoilt(timestamp="2026-07-20T14:37:01.001Z"), "timestamp is more than 5 minutes in the future"),
    (spoilt(timestamp="x" * 500), "invalid timestamp: '" + "x" * 64 + "...'"),
    (spoilt(level="critical"), "invalid level: 'critical'"), (spoilt(level="ERROR"), "invalid level: 'ERROR'"),
    (spoilt(level=KeyError), "level is required"), (spoilt(level=3), "level must be a string"),
    (spoilt(service=KeyError), "service is required"), (spoilt(message=KeyError), "message is required"),
    (spoilt(service=""), "service must be a non-empty string"), (spoilt(service=42), "service must be a non-empty string"), (spoilt(service=" "), None),
    (spoilt(message=""), "message must be a non-empty string"), (spoilt(message={}), "message must be a non-empty string"),
    (spoilt(attributes="x"), "attributes must be an object"), (spoilt(attributes=[]), "attributes must be an object"),
    (spoilt(attributes={"a": 1, "z": {}, "b": None}), "attributes.z must be a string, number or boolean"),
    (spoilt(attributes={"z": {}, "10": [], "9": None}), "attributes.9 must be a string, number or boolean"),
    (spoilt(attributes={"a": []}), "attributes.a must be a string, number or boolean"), (spoilt(attributes={"a": None}), "attributes.a must be a string, number or boolean"),
    (spoilt(attributes={}), None), (spoilt(attributes=None), None), (spoilt(attributes={"a": "x", "b": 1.5, "c": False}), None),
]


def test_every_rule(spark):
    body = json.dumps({"logs": [c for c, _ in CASES]})
    batch = split_batch(spark.createDataFrame([(1, body)], "k int, body string"), NOW)
    got = {r["index"]: r["reason"] for r in batch.entries.collect()}
    assert [got[i] for i in range(len(CASES))] == [reason for _, reason in CASES]


def test_numbers_that_are_not_finite(spark):
    body = '{"logs": [' + json.dumps(GOOD)[:-1] + ', "attributes": {"n": 1e999}}]}'
    batch = split_batch(spark.createDataFrame([(1, body)], "k int, body string"), NOW)
    assert batch.entries.first()["reason"] == "attributes.n must be a string, number or boolean"


def test_repeated_keys_keep_the_last(spark):
    body = '{"logs": [' + json.dumps(GOOD)[:-1] + ', "level": "nope"}]}'
    assert split_batch(spark.createDataFrame([(1, body)], "k int, body string"), NOW).entries.first()["reason"] == "invalid level: 'nope'"


@pytest.mark.parametrize(
    ("body", "error"),
    [
        ('{"logs": [', "malformed JSON body"), ("", "malformed JSON body"), (None, "malformed JSON body"), ("{} x", "malformed JSON body"), ('{"logs":[1]} ]', "malformed JSON body"),
        ("[1]", "body must be a JSON object"), ('"logs"', "body must be a JSON object"), ("null", "body must be a JSON object"),
        ('{"entries": []}', "logs must be an array"), ('{"logs": {}}', "logs must be an array"), ('{"logs": []}', "logs must not be empty"),
    ],
)
def test_envelope_errors(spark, body, error):
    batch = split_batch(spark.createDataFrame([(1, body)], "k int, body string"), NOW)
    assert batch_report(batch, "k").collect() == [(1, 0, [], error)]


def test_mixed_batch_and_types(spark):
    logs = [spoilt(attributes={"region": "eu", "n": 3, "b": True}), 7, GOOD, spoilt(level="x"), spoilt(service="")]
    batch = split_batch(spark.createDataFrame([(1, json.dumps({"logs": logs})), (2, '{"logs": [1, 2]}')], "k int, body string"), NOW)
    report = {r["k"]: r for r in batch_report(batch, "k").collect()}
    assert report[1]["accepted"] == 2 and [x["index"] for x in report[1]["rejected"]] == [1, 3, 4] and report[1]["outcome"] == "ok"
    assert report[2]["accepted"] == 0 and report[2]["outcome"] == "all entries were rejected"
    first = batch.accepted().orderBy("index").first()
    assert {k: (v["kind"], v["str"], v["num"], v["bool"]) for k, v in first["attributes"].items()} == {"region": ("string", "eu", None, None), "n": ("number", None, 3.0, None), "b": ("boolean", None, None, True)}
    assert batch.rejected().count() == 5


def test_envelopes_of_one_user_are_bounded(spark, tmp_path):
    from siltlog.plans import queries

    spark.sql("select id as event_id, 5L as user_id, timestamp_ntz'2024-01-01' as ts, 'view' as event_type, '{\"k\": 1}' as props from range(1800)").write.parquet(f"{tmp_path}/events.parquet")
    sizes = [len(json.loads(r["body"])["logs"]) for r in queries._envelopes(spark, str(tmp_path)).collect()]
    assert max(sizes) <= 500 and sum(sizes) == 1800
    report = queries.QUERIES["validate_report"](spark, str(tmp_path)).collect()
    assert len(report) == 1 and report[0]["accepted"] == 400
    assert [int(x.split(" ")[0]) for x in report[0]["rejected"].split("; ")] == [k for k in range(1800) if k % 9 not in (0, 8)]
    index = [r["index"] for r in queries.QUERIES["validated_records"](spark, str(tmp_path)).collect()]
    assert sorted(index) == [k for k in range(1800) if k % 9 in (0, 8)]
