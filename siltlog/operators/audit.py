"""Jobs that prove the rollup and the ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltlog.functions.timestamps import bucket_start, seconds_text
from siltlog.operators.rollup import KEY, build_rollup, day_digests, merge_rollup
from siltlog.schema import MINUTE_MS
from siltlog.sources.scratch import scratch_path
from siltlog.sources.table import LogTable, day_of

#: Rows whose ids are looked at as a unit, and spans of ids that are asked for one by one; beyond that near ones are merged.
UNIT, SPANS = 1 << 20, 200


def _minutes(rows: DataFrame) -> DataFrame:
    """Rows as counts of one, by day."""
    return rows.select(bucket_start(F.col("ts"), MINUTE_MS).alias("bucket"), "service", "level", F.lit(1).cast("long").alias("count"), day_of(F.col("ts")).alias("day"))


def differing_days(want: DataFrame, have: DataFrame) -> list[date]:
    """Days whose (day, n, digest) differ; the driver gets only these."""
    have = have.select(F.col("day").alias("on"), F.col("n").alias("m"), F.col("digest").alias("other"))
    both = want.join(have, F.col("day").eqNullSafe(F.col("on")), "full_outer")
    same = F.coalesce((F.col("n") == F.col("m")) & (F.col("digest") == F.col("other")), F.lit(False))
    return sorted(r[0] for r in both.filter(~same).select(F.coalesce("day", "on")).collect())


def _compared(logs: DataFrame, rollup: DataFrame) -> DataFrame:
    want = build_rollup(logs).select(*[F.col(c).alias(f"w_{c}") for c in (*KEY, "count")])
    have = merge_rollup(rollup).select(*[F.col(c).alias(f"h_{c}") for c in (*KEY, "count")])
    on = [F.col(f"w_{c}").eqNullSafe(F.col(f"h_{c}")) for c in KEY]
    both = want.join(have, on, "full_outer").filter(~F.col("w_count").eqNullSafe(F.col("h_count")))
    present = F.col("w_count").isNotNull()
    keys = [F.when(present, F.col(f"w_{c}")).otherwise(F.col(f"h_{c}")).alias(c) for c in KEY]
    rows = both.select(*keys, F.coalesce("w_count", F.lit(0)).alias("expected"), F.coalesce("h_count", F.lit(0)).alias("found"))
    return rows.withColumn("bucket", seconds_text(F.col("bucket")))


def audit_rollup(logs: DataFrame, rollup: DataFrame) -> DataFrame:
    """(bucket, service, level, expected, found) where the rollup disagrees with the base rows; empty if all is well.

    Both sides are first added up to a digest for each day, which shuffles a row a day and task. Only
    days that differ are counted by minute and joined; keys are compared null-safe.
    """
    rollup = rollup.withColumn("day", day_of(F.col("bucket")))
    days = differing_days(day_digests(_minutes(logs)), day_digests(rollup))
    if not days:
        return _compared(logs.limit(0), rollup.limit(0))
    day = day_of(F.col("ts")) if "day" not in logs.columns else F.col("day")  # a partition column prunes files
    return _compared(logs.filter(day.isin(days)), rollup.filter(F.col("day").isin(days)))


def stored_digests(table: LogTable) -> DataFrame:
    """(day, n, digest) of the rows that are in the table, from what each batch's commit says of them."""
    seen = table.snapshot()
    there = [(area, str(day), n) for _, area, day, _, ids in table._places("logs", seen) for n in ids]
    files = table.spark.read.option("pathGlobFilter", "*.json").option("wholetext", "true").text(f"{table.root}/_batches")
    rows = files.select(F.regexp_extract("_metadata.file_name", r"^(\d+)\.json", 1).cast("long").alias("batch_id"), F.explode(F.from_json("value", "days map<string, array<long>>")["days"]).alias("at", "held"))
    rows = rows.select("batch_id", F.substring_index("at", "/", 1).alias("area"), F.substring_index("at", "/", -1).alias("day"), "held")
    rows = rows.join(table.spark.createDataFrame(there, "area string, day string, batch_id long"), ["area", "day", "batch_id"], "left_semi")
    sums = [F.sum(F.get("held", F.lit(k))) for k in range(4)]
    return rows.groupBy(F.col("day").cast("date").alias("day")).agg(sums[0].alias("n"), F.array(*sums[1:]).alias("digest"))


def audit_table(table: LogTable, deep: bool = True) -> DataFrame:
    """`audit_rollup` of a table. Not `deep`, its counts are held against the digests that were stored at commit, and no row is read for days that agree."""
    seen = table.snapshot()
    if deep:
        return audit_rollup(seen.logs(), seen.rollup())
    days = differing_days(stored_digests(table), day_digests(seen.rollup()))
    return _compared(seen.logs().filter(F.col("day").isin(days)), seen.rollup().filter(F.col("day").isin(days)))


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each unit of a partition's rows its least and largest id, and the ids that it has more than once."""

    def unit(ids: np.ndarray, nulls: int) -> pa.RecordBatch:
        found, counts = np.unique(ids, return_counts=True)
        low = [int(found[0])] if len(found) else [None]
        high = [int(found[-1])] if len(found) else [None]
        more = counts > 1
        n = int(more.sum())
        columns = [low + [None] * n, high + [None] * n, [None, *found[more].tolist()], [nulls, *counts[more].tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["low", "high", "id", "count"])

    held, size, nulls = [], 0, 0
    for batch in batches:
        column = batch.column(0)
        nulls += column.null_count
        held.append(column.drop_null().to_numpy(zero_copy_only=False))
        size += len(held[-1])
        if size >= UNIT:
            yield unit(np.concatenate(held), nulls)
            held, size, nulls = [], 0, 0
    if held:
        yield unit(np.concatenate(held), nulls)


def crossing(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ids that two or more spans [low, high] share, as spans; beyond SPANS of them the nearest are merged."""
    edges = sorted([(low, 0) for low, _ in spans] + [(high, 1) for _, high in spans])
    open_, out, begin = 0, [], 0
    for at, closes in edges:
        if not closes:
            open_ += 1
            if open_ == 2:
                begin = at
        else:
            open_ -= 1
            if open_ == 1:
                if out and begin <= out[-1][1]:
                    out[-1] = (out[-1][0], at)
                else:
                    out.append((begin, at))
    if len(out) > SPANS:
        gaps = sorted(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1], reverse=True)[: SPANS - 1]
        cuts = [0, *sorted(gaps), len(out)]
        out = [(out[a][0], out[b - 1][1]) for a, b in zip(cuts, cuts[1:])]
    return out


def audit_ids(logs: DataFrame) -> DataFrame:
    """(id, count) of ids that more than one row has; rows without an id count as those of the id null.

    A sweep over the [least, largest] id of units of rows finds the ids that units can share. Repeats
    within a unit are found where it lies; only rows whose ids lie in a shared span are shuffled, none
    where no spans cross. The driver gets two numbers for each unit of about a million rows.
    """
    path, spark = scratch_path(logs.sparkSession, "id-units"), logs.sparkSession
    kind = "low long, high long, id long, count long"
    logs.select(F.col("id").cast("long").alias("id")).mapInArrow(_units, kind).write.parquet(path)
    units = spark.read.schema(kind).parquet(path)
    shared = crossing([(r["low"], r["high"]) for r in units.filter("low is not null").select("low", "high").toLocalIterator()])

    def within() -> Column:
        held = F.lit(False)
        for low, high in shared:
            held = held | F.col("id").between(low, high)
        return held

    inner = units.filter(F.col("id").isNotNull() & ~within()).select("id", "count")
    nulls = units.filter("id is null").agg(F.lit(None).cast("long").alias("id"), F.sum("count").alias("count"))
    found = inner.unionByName(nulls)
    if shared:
        found = found.unionByName(logs.select(F.col("id").cast("long").alias("id")).filter(within()).groupBy("id").agg(F.count("*").alias("count")))
    return found.filter("count > 1")


def id_summary(logs: DataFrame) -> DataFrame:
    """(total, distinct_ids) of all rows."""
    return logs.agg(F.count("*").alias("total"), F.count_distinct("id").alias("distinct_ids"))
