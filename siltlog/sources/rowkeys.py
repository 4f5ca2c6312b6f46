"""Keys of the rows of stored tables, the same however the files are cut when they are read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.sources.scratch import scratch_path

#: Files whose numbers are sent to every executor, at most; beyond that they are joined by a shuffle.
SENT_FILES = 100_000
#: Bits for the place of a row in its file.
ROW_BITS = 40
#: An empty authority, which some forms of a path have and others have not.
_EMPTY = r"^([^:/]+):///", r"\1:/"


def with_row_key(rows: DataFrame, name: str) -> DataFrame:
    """`rows` of Parquet files with a key of each row in the column `name`: the number of its file, by name order, and its place in it.

    Rows that do not come from Parquet files are written to scratch first. A row whose file has no
    number fails the job. A column of this name that is there already is an error.
    """
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name}")
    spark = rows.sparkSession
    files = sorted({re.sub(*_EMPTY, f) for f in rows.inputFiles()})
    try:
        meta = rows.metadataColumn("_metadata")
        keyed = rows.select("*", F.regexp_replace(meta["file_path"], _EMPTY[0], "$1:/").alias("__file"), meta["row_index"].alias("__at"))
        keyed.schema  # noqa: B018 - is analysed here
    except Exception as e:
        if "UNRESOLVED_COLUMN" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
            raise
        path = scratch_path(spark, "rows")
        rows.write.parquet(path)
        return with_row_key(spark.read.schema(rows.schema).parquet(path), name)
    numbers = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "__file string, __number long")
    joined = keyed.join(F.broadcast(numbers) if len(files) <= SENT_FILES else numbers, "__file", "left")
    number = F.coalesce("__number", F.raise_error(F.lit("a row's file is not among those of the table")).cast("long"))
    return joined.withColumn(name, F.shiftleft(number, ROW_BITS) + F.col("__at")).drop("__file", "__number", "__at")
