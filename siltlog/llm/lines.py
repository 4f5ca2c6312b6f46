"""Removal of lines that many documents share, over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.shared import shared_path, stored

BLANKS = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hashed(key: Column) -> Column:
    """128 bits of a key as two seeded 64-bit hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


#: Has Spark take a bucket of one file as sorted, so that runs are merged without sorting them again.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, keeper, fresh): each key is fresh in one run, that of the batch that met it first.

    A run is a table bucketed and sorted by key, with as many buckets as a shuffle has partitions. A
    new batch is shuffled once, when its keys are counted, and merge-joined bucket by bucket with the
    runs as they lie: keys that no run holds are fresh, the others are repeats. When a level has `fan`
    runs they are merged into one of the next level, so a batch meets a number of runs logarithmic in
    the number of batches. `close` forgets the tables; their files are scratch.
    """

    def __init__(self, spark: SparkSession, fan: int = 3) -> None:
        self.spark, self.fan = spark, fan
        initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
        self.buckets = int(initial or spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.schema = None

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name], self.schema = shared_path(self.spark, "line-run"), rows.schema
        before = self.spark.conf.get(ORDERED, None)
        self.spark.conf.set(ORDERED, "true")
        try:
            made = rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
            made.option("path", self.paths[name]).saveAsTable(name)
        finally:
            self.spark.conf.set(ORDERED, before) if before else self.spark.conf.unset(ORDERED)
        return name

    def _all(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _union(self, names: list[str]) -> DataFrame:
        # as plain files: Spark 4.1 takes a union of bucketed scans for bucketed, but does not line the buckets up
        return self.spark.read.schema(self.schema).parquet(*[self.paths[name] for name in names])

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, id), a row for each key of each document."""
        rows = batch.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        known = []
        for k, name in enumerate(self._all()):
            run = self.spark.table(name).filter("fresh").select(*KEY, F.lit(True).alias(f"in_{k}"))
            rows, known = rows.join(run, KEY, "left"), [*known, F.col(f"in_{k}")]
        fresh = F.coalesce(*known, F.lit(False)) == F.lit(False)
        self._push(0, self._write(rows.select(*KEY, "n_docs", "keeper", fresh.alias("fresh"))))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan:
            rows = self._union(self.levels[level]).groupBy(*KEY)
            merged = self._write(rows.agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh")))
            self._drop(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, merged)

    def shared(self, least: int) -> DataFrame:
        """(h1, h2, keeper) of keys that `least` documents or more hold; keeper is the largest id."""
        total = self._union(self._all()).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return total.filter(F.col("n_docs") >= least).select(*KEY, "keeper")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._drop(self._all())
        self.levels = []


def drop_shared_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 5, least_chars: int = 40, batches: int = 4) -> DataFrame:
    """The columns of `docs`, text without shared lines, and n_lines and n_dropped (names as given; an input column so named is replaced).

    A line's key is the line trimmed of white space, A-Z lower-cased. Keys of `least_chars` code
    points or more that `least_docs` rows or more hold lose all their lines but those of the rows
    with the largest id that holds it. The corpus is taken in `batches` parts, one after another.

    Null text counts as one empty line and comes back as an empty text. Every row counts as a
    document, also one that repeats an id; a row whose id is null counts but never keeps a shared
    line. Ties cannot occur: rows of the largest id all keep the line.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    lines = F.split("text", "\n")
    keys = F.array_distinct(F.transform(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= least_chars), _hashed))
    part = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
    held = rows.select("id", part.alias("part"), keys.alias("keys")).select("id", "part", F.inline("keys"))
    path = shared_path(spark, "lines")
    held.write.partitionBy("part").parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    runs = LineRuns(spark)
    for k in range(batches):
        runs.add(held.filter(F.col("part") == k))
    shared = stored(runs.shared(least_docs), "shared-lines")
    runs.close()
    drops = held.join(shared, KEY).filter(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", F.struct(*KEY).alias("key"))
    drops = drops.groupBy(F.col("id").alias("of")).agg(F.collect_set("key").alias("drops"))
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("of")), "left")
    kept = F.when(F.col("drops").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.length(F.trim(x, F.lit(BLANKS))) < least_chars) | ~F.array_contains("drops", _hashed(line_key(x)))))
    out = joined.select("id", "rest", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select(F.col("id").alias(id_col), F.array_join("kept", "\n").alias(text_col), *[F.col(f"rest.`{c}`").alias(c) for c in others], "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
