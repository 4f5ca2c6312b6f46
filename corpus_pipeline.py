"""From raw documents to training sequences: five stages, each written as Parquet and read by the next.

A stage keys rows by file and place in the file, so `docs` should be a Parquet table; other rows are
written down first. Keys hold however the files are cut, so executors may come and go between readings.
The first four return the columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm import lines, neardup, packing, quality, rules
from siltlog.llm.shared import stored
from siltlog.sources.rowkeys import with_row_key

#: A set of row keys is sent to every executor up to this many (8 bytes each), else both sides are shuffled.
SENT_IDS = 1_000_000
#: Column of the row key within a stage.
ROW = "__row"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good, learnt from the labels of documents that are here.

    Rows are judged one by one, also those that repeat an id; a null id only has no label.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = _keyed(docs)
    judged = quality.classify(rows, model, without=docs.columns)
    return _without(rows, judged.filter(~F.col("kept")).select(ROW), docs)


def check_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule. Rows are judged and dropped one by one, whether ids are null or repeat."""
    return rules.passing(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; n_chars follows the text.

    Each row counts as a document, also one that repeats an id; a null id keeps no shared line.
    """
    out = lines.drop_shared_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id; nulls come last.

    Each row is a document of its own: rows that repeat an id stay unless their texts are alike, and
    rows without an id are compared as any other. Of texts without a word, which link with nothing,
    one row of equal id and text stays.
    """
    rows = _keyed(docs)
    groups = neardup.near_duplicates(rows, id_col=ROW).select(ROW, "n_shingles", "component_id")
    ids = rows.select(ROW, "doc_id", F.md5("text").alias("digest")).join(groups, ROW)
    linked = F.col("n_shingles") > 0
    group = [F.when(linked, F.col("component_id")), F.when(~linked, F.struct("doc_id", "digest"))]
    stay = ids.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias(ROW)).select(ROW)
    stay = stored(stay, "staying")
    return rows.join(F.broadcast(stay) if stay.count() <= SENT_IDS else stay, ROW, "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 tokens, as pieces with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), specials=True)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, the same on each reading; a column of the key's name is an error."""
    return with_row_key(docs, ROW)


def _without(rows: DataFrame, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows whose keys are not among `gone`, with the columns of `docs`."""
    gone = stored(gone, "rejected")
    return rows.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, ROW, "left_anti").select(*docs.columns)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", check_rules),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("packing", pack),
]

#: The classifier, the near-duplicate search and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
