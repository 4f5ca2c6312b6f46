"""Validation of ingest envelopes and of every entry in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltlog.functions.attributes import allowed, json_type, type_attributes
from siltlog.functions.timestamps import parse_millis
from siltlog.schema import LEVELS

#: Fixed values.
MAX_SKEW_MS, PREVIEW = 5 * 60 * 1000, 64
_MARK = "~end-of-envelope-5c2f~"


def check_envelope(envelopes: DataFrame, body: str = "body") -> DataFrame:
    """Adds `error` (null if there is none) and `entries`, an array of (entry variant, text of the entry).

    A marker behind the body tells a whole body from one followed by more text.
    """
    parsed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(body), F.lit(f',"{_MARK}"]'))), "$", "array<variant>")
    rows = envelopes.withColumn("__parsed", parsed)
    whole = (F.size("__parsed") == 2) & (F.try_variant_get(F.get("__parsed", F.lit(1)), "$", "string") == _MARK)
    rows = rows.withColumn("__value", F.when(F.coalesce(whole, F.lit(False)), F.get("__parsed", F.lit(0))))
    logs = F.try_variant_get(F.col("__value"), "$.logs", "variant")
    rows = rows.withColumn("__list", F.when((json_type(F.col("__value")) == "OBJECT") & (json_type(logs) == "ARRAY"), F.try_variant_get("__value", "$.logs", "array<variant>")))
    error = (
        F.when(F.col("__value").isNull(), "malformed JSON body")
        .when(json_type(F.col("__value")) != "OBJECT", "body must be a JSON object")
        .when(F.col("__list").isNull(), "logs must be an array")
        .when(F.size("__list") == 0, "logs must not be empty")
    )
    texts = F.from_json(F.col(body), "struct<logs: array<string>>")["logs"]
    rows = rows.withColumn("error", error)
    rows = rows.withColumn("__texts", F.when(F.col("error").isNull(), texts))
    # the text of an entry is there for the order of its keys only, which a variant does not keep;
    # zipped and not looked up by place, which would parse the body anew for every entry
    pairs = F.arrays_zip(F.col("__list").alias("entry"), F.col("__texts").alias("text"))
    rows = rows.withColumn("entries", F.when(F.col("error").isNull(), pairs))
    return rows.drop("__parsed", "__value", "__list", "__texts")


def explode_entries(envelopes: DataFrame) -> DataFrame:
    """A row per entry, with its `index` from 0; an envelope with an error is one row without an entry."""
    keep = [c for c in envelopes.columns if c not in ("entries", "body")]
    rows = envelopes.select(*keep, F.posexplode_outer("entries").alias("index", "__e"))
    return rows.select(*keep, "index", F.col("__e.entry").alias("entry"), F.col("__e.text").alias("entry_text"))


def _preview(text: Column) -> Column:
    return F.when(F.length(text) > PREVIEW, F.concat(F.substring(text, 1, PREVIEW), F.lit("..."))).otherwise(text)


def _absent(kind: Column) -> Column:
    return kind.isNull() | (kind == "VOID")


def check_timestamp(kind: Column, text: Column, millis: Column, now_ms: int) -> Column:
    """Reason against a timestamp of a JSON type and text, or null; `millis` is the parsed text. Old times are fine."""
    return (
        F.when(_absent(kind), "timestamp is required")
        .when(kind != "STRING", "timestamp must be a string")
        .when(millis.isNull(), F.concat(F.lit("invalid timestamp: '"), _preview(text), F.lit("'")))
        .when(millis > now_ms + MAX_SKEW_MS, "timestamp is more than 5 minutes in the future")
    )


def check_level(kind: Column, text: Column) -> Column:
    return (
        F.when(_absent(kind), "level is required")
        .when(kind != "STRING", "level must be a string")
        .when(~text.isin(*LEVELS), F.concat(F.lit("invalid level: '"), _preview(text), F.lit("'")))
    )


def check_text(kind: Column, text: Column, field: str) -> Column:
    """White space counts as text."""
    return F.when(_absent(kind), f"{field} is required").when((kind != "STRING") | (F.length(text) == 0), f"{field} must be a non-empty string")


def check_attributes(kind: Column, attributes: Column, text: Column) -> Column:
    """Reason against attributes: not an object, or its first key, in the order of its source, with a bad value.

    Keys that are array indexes come first in rising order, as a JavaScript object lists them.
    """
    number = r"^(0|[1-9]\d{0,9})\z"

    def named(bad: Column) -> Column:
        keys = F.json_object_keys(F.get_json_object(text, "$.attributes"))
        indexes = F.array_sort(F.transform(F.filter(keys, lambda k: k.rlike(number) & (k.try_cast("long") < 2**32 - 1)), lambda k: k.cast("long")))
        ordered = F.concat(F.transform(indexes, lambda k: k.cast("string")), keys)
        first = F.get(F.filter(F.coalesce(ordered, bad), lambda k: F.array_contains(bad, k)), F.lit(0))
        return F.when(F.size(bad) > 0, F.concat(F.lit("attributes."), first, F.lit(" must be a string, number or boolean")))

    reason = F.get(F.transform(F.array(F.map_keys(F.map_filter(attributes, lambda _, v: ~allowed(v)))), named), F.lit(0))
    return F.when(~_absent(kind), F.when(kind != "OBJECT", "attributes must be an object").otherwise(reason))


FIELDS = ("timestamp", "level", "service", "message")


def validate_entries(entries: DataFrame, now_ms: int) -> DataFrame:
    """Adds `reason` (null: accepted) and the fields of a record; the first failing rule gives the reason."""
    kinds = {f"__kind_{c}": json_type(F.try_variant_get("entry", f"$.{c}", "variant")) for c in (*FIELDS, "attributes")}
    rows = entries.withColumns({"__kind": json_type(F.col("entry"))} | kinds)
    texts = {f"__{c}": F.when(F.col(f"__kind_{c}") == "STRING", F.try_variant_get("entry", f"$.{c}", "string")) for c in FIELDS}
    held = F.when(F.col("__kind_attributes") == "OBJECT", F.try_variant_get("entry", "$.attributes", "map<string,variant>"))
    rows = rows.withColumns(texts | {"__attributes": held})
    rows = rows.withColumn("__millis", parse_millis(F.col("__timestamp")))

    def of(name: str) -> tuple[Column, Column]:
        return F.col(f"__kind_{name}"), F.col(f"__{name}")

    rules = F.coalesce(
        check_timestamp(*of("timestamp"), F.col("__millis"), now_ms),
        check_level(*of("level")),
        check_text(*of("service"), "service"),
        check_text(*of("message"), "message"),
        check_attributes(*of("attributes"), F.col("entry_text")),
    )
    rows = rows.withColumn("reason", F.when(F.col("__kind") == "OBJECT", rules).otherwise("entry must be an object"))
    ok = F.col("reason").isNull()
    typed = F.coalesce(type_attributes(F.col("__attributes")), F.create_map().cast("map<string,struct<kind:string,str:string,num:double,bool:boolean>>"))
    keep = [c for c in entries.columns if c not in ("entry", "entry_text")]
    return rows.select(
        *keep,
        "reason",
        F.when(ok, F.timestamp_millis("__millis")).alias("ts"),
        *[F.when(ok, F.col(f"__{c}")).alias(c) for c in FIELDS[1:]],
        F.when(ok, typed).alias("attributes"),
    )


@dataclass(frozen=True)
class Batch:
    """A validated batch: `rows` has the entries, and a row with an `error` for each envelope that failed whole.

    All parts come from one pass over the envelopes; `rows` is best written once (`operators.ids.stage`)
    where more than one is used.
    """

    rows: DataFrame

    @property
    def entries(self) -> DataFrame:
        return self.rows.filter("error is null").drop("error")

    def accepted(self) -> DataFrame:
        return self.entries.filter("reason is null").drop("reason")

    def rejected(self) -> DataFrame:
        return self.entries.filter("reason is not null").drop("ts", "level", "service", "message", "attributes")

    def failed(self) -> DataFrame:
        return self.rows.filter("error is not null").drop("index", "reason", "ts", "level", "service", "message", "attributes")

    @staticmethod
    def counts() -> dict[str, Column]:
        """Accepted and rejected entries and failed envelopes, as aggregates of `rows`."""
        whole, good = F.col("error").isNull(), F.col("reason").isNull()
        return {"rows": F.count_if(whole & good), "rejected": F.count_if(whole & ~good), "failed_envelopes": F.count_if(~whole)}


def split_batch(envelopes: DataFrame, now_ms: int, body: str = "body") -> Batch:
    """Envelopes checked, exploded and validated in one pass; one bad entry never fails its batch."""
    rows = validate_entries(explode_entries(check_envelope(envelopes, body)), now_ms)
    return Batch(rows.withColumn("reason", F.when(F.col("error").isNull(), F.col("reason"))))


def batch_report(batch: Batch, key: str) -> DataFrame:
    """(key, accepted, rejected array of (index, reason) in order, outcome) per envelope.

    A report is as long as its envelope, which is one line of input.
    """
    bad = F.col("reason").isNotNull()
    found = batch.rows.groupBy(key).agg(
        F.count_if(~bad & F.col("error").isNull()).alias("accepted"),
        F.array_sort(F.collect_list(F.when(bad, F.struct("index", "reason")))).alias("rejected"),
        F.max("error").alias("error"),
    )
    return found.withColumn("outcome", F.coalesce("error", F.when(F.col("accepted") > 0, "ok").otherwise("all entries were rejected"))).drop("error")
