"""How five filters interact, decided on a sparse document-term matrix of the whole corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltlog.llm import words
from siltlog.llm.blocks import expand, squeeze, text_blocks
from siltlog.llm.dictionary import bucket_count, entry_rows, ids_by_number, known_words, numbered, numbers, spans_of
from siltlog.llm.shared import stored

FILTERS = "ABCDE"
#: Text bytes of a shard.
BLOCK_BYTES = 16_000_000
#: Parts in which rows without an id are joined.
SALTS = 64
_CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
_FIRST = (np.arange(256) & 0xC0) != 0x80  # of a character


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    return np.diff(np.searchsorted(np.flatnonzero(marks), offsets))


_CELLS = ["indptr", "indices", "data", "bucket", "places", "names", "counts"]


def _shards(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for the matrix of a block, by its own word numbers, and one for its words in each bucket."""
    base = TaskContext.get().partitionId() << 24
    for k, (rows, texts) in enumerate(text_blocks(batches, BLOCK_BYTES)):
        data, offsets = words.flat(texts)
        starts, ends, before = spans_of(data, offsets)
        codes, names = numbers(data, starts, ends)
        counts = np.bincount(codes, minlength=len(names))
        row = np.repeat(np.arange(len(texts)), np.diff(before))
        cells, times = np.unique(row << 32 | codes, return_counts=True)
        width = np.bincount(cells >> 32, minlength=len(texts))
        made = [_sums(_CAPITAL[data], offsets), _sums(_FIRST[data], offsets), _sums(_SYMBOL[data], offsets)]
        held = pa.StructArray.from_arrays([rows, *map(pa.array, made)], ["row", "capitals", "chars", "symbols"])
        entries = entry_rows(names, counts, buckets)
        n = len(entries)
        lists = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        lists = pa.concat_arrays([lists, pa.nulls(n, lists.type)])
        first = [pa.array([squeeze(x), *[None] * n], pa.binary()) for x in (width, cells & 0xFFFFFFFF, times)]
        last = list(zip(*entries)) if entries else [()] * 4
        last = [pa.array([None, *c], pa.int32() if j == 0 else pa.binary()) for j, c in enumerate(last)]
        yield pa.RecordBatch.from_arrays([pa.array([base + k] * (n + 1)), lists, *first, *last], ["shard", "rows", *_CELLS])


def _global(blocks: pa.Table, known: pa.Table) -> pa.Table:
    """The matrix of a block with the dictionary's ids in place of its own numbers, those of a row in rising order."""
    blocks = blocks.filter(pc.is_valid(blocks.column("rows")))
    ids, indices, data = ids_by_number(known), [], []
    for width, index, times in zip(*(map(expand, blocks.column(c).to_pylist()) for c in ("indptr", "indices", "data")), strict=True):
        index = ids[index]
        order = np.lexsort((index, np.repeat(np.arange(len(width)), width)))
        indices.append(squeeze(index[order]))
        data.append(squeeze(times[order]))
    return blocks.select(["shard", "rows", "indptr"]).append_column("indices", pa.array(indices, pa.binary())).append_column("data", pa.array(data, pa.binary()))


def _open(kind: T.DataType) -> T.DataType:
    """The type with every part nullable, as Arrow functions return it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _open(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_open(kind.elementType))
    return T.MapType(kind.keyType, _open(kind.valueType)) if isinstance(kind, T.MapType) else kind


def document_terms(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The sparse matrix of word counts as CSR shards (shard, rows, indptr, indices, data), and the dictionary (id, word, count).

    Words are runs of characters other than white space, as they stand. `rows` lists, for each row of a
    shard, the other columns of `docs` as `row`, and its capitals, code points and symbols; indptr holds
    how many cells each row has, indices their word ids, data the counts (`blocks.expand` reads them).
    A null text is empty and has no cells. Each word crosses the shuffle once for each shard that has it.
    """
    parts = bucket_count(docs)
    others = _open(T.StructType([f for f in docs.schema.fields if f.name != text_col]))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others.fieldNames()]).alias("row"), F.col(text_col).alias("text"))
    kind = T.StructType().add("row", others).add("capitals", "long").add("chars", "long").add("symbols", "long")
    schema = T.StructType().add("shard", "long").add("rows", T.ArrayType(kind))
    for c in _CELLS:
        schema = schema.add(c, "integer" if c == "bucket" else "binary")
    blocks = stored(rows.mapInArrow(lambda it: _shards(it, parts), schema), "term-blocks")
    entries = blocks.filter("bucket is not null").select(F.col("shard").alias("block"), "bucket", "places", "names", "counts")
    coded = stored(numbered(entries, parts), "terms")
    matrix = blocks.filter("rows is not null").select("shard", "rows", "indptr", "indices", "data")
    back = coded.filter("block is not null").select(F.col("block").alias("shard"), "places", "ids")
    shards = matrix.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_global, T.StructType(schema.fields[:5]))
    words_ = known_words(coded).select("id", F.col("name").cast("string").alias("word"), "count")
    return stored(shards, "term-shards"), words_


def _measures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, capitals, chars, symbols, n_words, n_distinct): sums and numbers of cells of the rows of shards."""
    for batch in batches:
        for rows, indptr, data in zip(batch.column("rows"), batch.column("indptr").to_pylist(), batch.column("data").to_pylist(), strict=True):
            width, reach = expand(indptr), np.concatenate([[0], np.cumsum(expand(data))])
            ends = np.cumsum(width)
            held = rows.values
            yield pa.RecordBatch.from_arrays([*(held.field(k) for k in range(4)), pa.array(reach[ends] - reach[ends - width]), pa.array(width)], ["row", "capitals", "chars", "symbols", "n_words", "n_distinct"])


def measures(shards: DataFrame) -> DataFrame:
    """Each document of the shards with its counts: words (row sum) and distinct words (cells of the row)."""
    kind = shards.schema["rows"].dataType.elementType
    return shards.select("rows", "indptr", "data").mapInArrow(_measures, T.StructType([*kind.fields, T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())]))


def failures(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, good, toxic, n): how many documents of a part fail just the filters in `fails`, a string of letters.

    A fails under 200 words, B under 50 distinct words in 100, C above 3 capitals A-Z in 100 code
    points, D with any of `#$%&*|`, E if a row of smaller id has the same text. Null texts are empty, a
    null part is an empty string. A row without an id has no label and neither fails E nor makes others
    fail; of rows that repeat an id and a text, none makes another fail. Of several labels for an id,
    any that says 1 counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tagged = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    shards, _ = document_terms(tagged)
    rows = measures(shards).select("row.*", "capitals", "chars", "symbols", "n_words", "n_distinct")
    tests = {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("capitals") > 3 * F.col("chars"),
        "D": F.col("symbols") > 0,
    }
    rows = rows.select("id", "part", "digest", F.concat(*[F.when(t, k).otherwise("") for k, t in tests.items()]).alias("fails"))
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0))
    marks = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.withColumn("zero", F.lit(0).cast("long"))
    rows = rows.join(marks, (F.col("id") == F.col("of")) & (F.col("salt") == F.col("zero")), "left")
    kind = ["part", "fails", "good", "toxic"]
    rows = rows.select("id", "digest", "part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    # rows of a digest and kind are added up before digests meet, so a text that many rows share is a few rows then
    same = rows.filter("id is not null").groupBy("digest", *kind, "id").agg(F.count("*").alias("n"))
    same = same.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = same.groupBy("digest").agg(F.min("first.id").alias("least"))
    same = same.join(least, "digest").withColumn("stay", F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0))
    cells = same.select(*kind, F.col("stay").alias("n")).unionByName(same.select("part", F.concat("fails", F.lit("E")).alias("fails"), "good", "toxic", (F.col("n") - F.col("stay")).alias("n")))
    cells = cells.unionByName(rows.filter("id is null").select(*kind, F.lit(1).cast("long").alias("n")))
    return cells.groupBy(*kind).agg(F.sum("n").alias("n"))


def audit(cells: DataFrame) -> DataFrame:
    """For each part, order of the filters and step, what the step's filter does: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("earlier", F.expr("substring(filter_order, 1, step - 1)"))
    gone = F.expr("translate(earlier, fails, '') <> earlier")
    failing = F.expr("instr(fails, letter) > 0")

    def total(test: Column, n: Column = F.col("n")) -> Column:
        return F.sum(F.when(test, n).otherwise(0))

    removed = failing & ~gone
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~failing).alias("kept"),
        total(removed).alias("removed"),
        total(failing & gone).alias("redundant"),
        total(F.col("fails") == F.col("letter")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        # of all orders, one in as many as filters fail has this one first among them
        total(failing, F.expr("n * (120 div greatest(length(fails), 1))")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(failures(docs.select("doc_id", "text", "lang"), labels))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM t),
m AS (SELECT x, min(doc_id) AS least FROM t GROUP BY x),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
  CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 3 * length(x) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END,
  CASE WHEN coalesce(w.doc_id > least, FALSE) THEN 'E' ELSE '' END) AS fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM w JOIN m USING (x) LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
e AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS e),
o AS (SELECT a.e || b.e || c.e || d.e || g.e AS filter_order FROM e a, e b, e c, e d, e g WHERE len(list_distinct([a.e, b.e, c.e, d.e, g.e])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1 : step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT c.*, s.*, contains(fails, letter) AS failing, fails <> '' AND earlier <> '' AND list_has_any(string_split(fails, ''), string_split(earlier, '')) AS gone FROM c, s)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN failing AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN failing AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN failing THEN n * 120 // length(fails) ELSE 0 END) AS BIGINT) AS shapley FROM r GROUP BY 1, 2, 3
"""
