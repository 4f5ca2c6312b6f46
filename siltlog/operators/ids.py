"""Unique row ids that carry the time of their batch."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltlog.sources.scratch import scratch_path

SEQUENCE_BITS = 20
PART, ROW = "__id_part", "__id_row"


def stage(rows: DataFrame, path: str, observed: Observation | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """`rows` written to `path` with the place of each (part, row in the part) as data, and read back.

    Places are written down once, so they stay what they are however the files are cut when they are
    read. `counts` are aggregates that `observed` holds after this one pass.
    """
    place = F.monotonically_increasing_id()
    rows = rows.withColumn(PART, F.shiftright(place, 33)).withColumn(ROW, place.bitwiseAND(F.lit((1 << 33) - 1)))
    kept = rows.observe(observed, *[c.alias(k) for k, c in (counts or {}).items()]) if observed else rows
    kept.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def number(staged: DataFrame, batch_ms: int, keep: bool = False) -> DataFrame:
    """Adds `id` to staged rows: (batch_ms << 20) plus the row's place; more than 2^20 rows run on into later milliseconds.

    Only a count for each written part goes to the driver. A row whose part is not counted fails the
    job instead of being lost. With `keep`, the places stay.
    """
    counts = sorted((r[0], r[1]) for r in staged.groupBy(PART).agg(F.max(ROW) + 1).collect())
    starts = [0, *accumulate(n for _, n in counts)][: len(counts)]
    # one row for each part of the batch
    offsets = staged.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=True)], f"{PART} long, __start long")
    joined = staged.join(F.broadcast(offsets), PART, "left")
    start = F.coalesce("__start", F.raise_error(F.lit("a row's part has no start")).cast("long"))
    return joined.withColumn("id", F.lit(batch_ms << SEQUENCE_BITS) + start + F.col(ROW)).drop("__start", *(() if keep else (PART, ROW)))


def assign_ids(rows: DataFrame, batch_ms: int, path: str | None = None) -> DataFrame:
    """Adds `id`: (batch_ms << 20) plus the row's place, without gaps.

    The rows are written once, to `path` or to scratch, with their places; ids are read from there,
    the same each time.
    """
    return number(stage(rows, path or scratch_path(rows.sparkSession, "numbered")), batch_ms)


def next_batch_ms(now_ms: int, last_id: int | None) -> int:
    """The batch time to use: past every id given out before, also if the clock went back."""
    return now_ms if last_id is None else max(now_ms, (last_id >> SEQUENCE_BITS) + 1)
