"""Continuous ingest of envelopes into a log table."""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltlog.operators.ids import PART, ROW, SEQUENCE_BITS, next_batch_ms, number, stage
from siltlog.operators.validate import Batch, split_batch
from siltlog.schema import RECORD, prepare
from siltlog.sources.envelopes import stream_envelopes, with_lines
from siltlog.sources.table import LogTable


def _last_id(table: LogTable) -> int | None:
    """The largest id that a batch may have given out; the names of `_ends` are such ids."""
    return max((int(n.removesuffix(".json")) for n in table.files.names("_ends") if n.endswith(".json")), default=None)


def _flushes(staged: DataFrame, max_bytes: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Places at which flushes of staged rows begin and end: each holds the envelopes that begin within its `max_bytes`.

    A size for each envelope is shuffled, by part; the driver gets two places for each flush.
    """
    sizes = staged.filter("bytes is not null").select(PART, ROW, "bytes")
    parts = sorted((r[0], r["n"], r["m"]) for r in sizes.groupBy(PART).agg(F.sum("bytes").alias("n"), F.max(ROW).alias("m")).collect())
    starts = dict(zip((p for p, *_ in parts), accumulate((n for _, n, _ in parts), initial=0)))
    if sum(n for _, n, _ in parts) <= max_bytes:
        return [((0, 0), (1 << 40, 0))]
    before = F.sum("bytes").over(Window.partitionBy(PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1))
    offsets = staged.sparkSession.createDataFrame([(p, s) for p, s in starts.items()], f"{PART} long, __start long")
    placed = sizes.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(offsets), PART)
    flush = ((F.col("before") + F.col("__start")) / max_bytes).cast("long")
    firsts = sorted(tuple(r["at"]) for r in placed.groupBy(flush.alias("flush")).agg(F.min(F.struct(PART, ROW)).alias("at")).collect())
    return list(zip([(0, 0), *firsts[1:]], [*firsts[1:], (1 << 40, 0)], strict=True))


def _within(first: tuple[int, int], end: tuple[int, int]) -> Column:
    at = F.struct(PART, ROW)
    return (at >= F.struct(*[F.lit(x).cast("long") for x in first])) & (at < F.struct(*[F.lit(x).cast("long") for x in end]))


def flush_id(batch_id: int, flush: int) -> int:
    """The number of a batch's flush in the table; that of the first is the batch's own."""
    return batch_id + (flush << 40)


def ingest_batch(table: LogTable, envelopes: DataFrame, batch_id: int, now_ms: int | None = None, max_bytes: int | None = None) -> dict:
    """Validate one micro-batch and write its rows and counts; done again, it gives the same table.

    Envelopes are parsed once: their entries are staged with their places, and the counts of accepted,
    rejected and failed ones come with that write. With `max_bytes` a batch is committed in flushes,
    each of the envelopes that begin within so many bytes of text, however large its files are; a
    replay goes on after the last that is committed.

    The batch's time is saved before any data is, and read back by a replay, so that ids, rejects and
    partitions come out the same. Ids follow the places of entries; those of rejected ones stay unused.
    Returns the metrics of the whole batch; each commit file holds those of its flush.
    """
    if (done := table.metrics(batch_id)) is not None and (done.get("flushes", 1) == 1 or table.metrics(flush_id(batch_id, done["flushes"] - 1)) is not None):
        return _whole(table, batch_id, done)
    table.files.put(f"_plans/{batch_id}.json", {"batch_ms": next_batch_ms(int(time.time() * 1000) if now_ms is None else now_ms, _last_id(table))})
    batch_ms = table.files.read(f"_plans/{batch_id}.json")["batch_ms"]  # of whoever came first
    today = datetime.fromtimestamp(batch_ms / 1000, UTC).date()
    sized = envelopes.withColumn("__bytes", F.octet_length("body").cast("long"))
    rows = split_batch(sized, batch_ms).rows
    first = F.coalesce("index", F.lit(0)) == 0  # an envelope's size stands with its first row
    rows = rows.select("error", "index", "reason", "ts", "level", "service", "message", "attributes", F.when(first, F.col("__bytes")).alias("bytes"))
    path, seen = f"{table.root}/_staging/{batch_id}-{uuid.uuid4().hex}", Observation()
    staged = stage(rows, path, seen, Batch.counts() | {"all": F.count(F.lit(1))})
    try:
        total = seen.get
        if total["all"]:
            table.files.put(f"_ends/{(batch_ms << SEQUENCE_BITS) + total['all'] - 1:020d}.json", {"batch_id": batch_id})
        spans = [((0, 0), (1 << 40, 0))] if max_bytes is None else _flushes(staged, max_bytes)
        numbered = number(staged, batch_ms, keep=True)
        for k, span in enumerate(spans):
            if table.metrics(flush_id(batch_id, k)) is not None:
                continue
            part, counts = numbered, total
            if len(spans) > 1:
                part = numbered.filter(_within(*span))
                counts = part.agg(*[c.alias(n) for n, c in Batch.counts().items()], F.sum("bytes").alias("bytes")).first().asDict()
            metrics = {n: int(counts[n]) for n in Batch.counts()} | {"batch_ms": batch_ms, "flushes": len(spans)} | ({"bytes": int(counts["bytes"] or 0)} if len(spans) > 1 else {})
            table.append_logs(Batch(part).accepted().select("id", *RECORD.fieldNames()), flush_id(batch_id, k), today, metrics=metrics)
        return _whole(table, batch_id, table.metrics(batch_id))
    finally:
        table.files.delete(path.removeprefix(f"{table.root}/"))


def _whole(table: LogTable, batch_id: int, first: dict) -> dict:
    """Metrics of a batch: the sums of its flushes."""
    parts = [first, *(table.metrics(flush_id(batch_id, k)) or {} for k in range(1, first.get("flushes", 1)))]
    return first | {n: sum(p.get(n, 0) for p in parts) for n in ("rows", "rejected", "failed_envelopes") if n in first}


def stream_ingest(spark: SparkSession, source: str, root: str, checkpoint: str, *, interval: str | None = None, max_bytes: int = 256 << 20, now_ms: int | None = None) -> StreamingQuery:
    """Envelopes from a folder of text files into the table at `root`.

    With an `interval` the stream runs on; without one it takes in what is there and stops.
    There is no watermark: old entries are as welcome as new ones. A micro-batch takes in whole files
    of about `max_bytes`; a larger file is committed in flushes of that size.
    """
    prepare(spark)
    table = LogTable(spark, root)
    lines = stream_envelopes(spark, source, max_bytes)
    writer = lines.writeStream.foreachBatch(lambda rows, n: ingest_batch(table, with_lines(rows), n, now_ms, max_bytes) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def ingest_metrics(table: LogTable) -> DataFrame:
    """(batch_id, rows, rejected, failed_envelopes, batch_ms, bytes) of committed flushes, read by Spark from their commit files."""
    kinds = "struct<rows: long, rejected: long, failed_envelopes: long, batch_ms: long, bytes: long>"
    if not table.batches():
        return table.spark.createDataFrame([], "batch_id long, rows long, rejected long, failed_envelopes long, batch_ms long, bytes long")
    files = table.spark.read.option("pathGlobFilter", "*.json").option("wholetext", "true").text(f"{table.root}/_batches")
    found = files.select(F.regexp_extract("_metadata.file_name", r"^(\d+)\.json", 1).cast("long").alias("batch_id"), F.from_json("value", f"metrics {kinds}")["metrics"].alias("m"))
    return found.select("batch_id", "m.*")
