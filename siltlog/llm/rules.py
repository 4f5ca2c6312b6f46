"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space, symbols, and frequent function words of English, German, French and Spanish.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "auf das der des die den ein er für ist mit sich und von zu "
    "au de des du en est et la le les par pour que qui un une "
    "con el los las por se y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if `above < metric` or `metric < below`; it needs `words` words for the rule to apply."""

    name: str
    metric: str
    below: float | None = None
    above: float | None = None
    words: int = 0


THRESHOLDS = (
    Rule("few_words", "n_words", below=10),
    Rule("repeated_words", "repeat_percent", above=20),
    Rule("symbols", "symbol_percent", above=10),
    Rule("short_words", "mean_word", below=2),
    Rule("long_words", "mean_word", above=12, words=20),
    Rule("no_stop_words", "stop_percent", below=3, words=50),
    Rule("repeated_lines", "dup_line_percent", above=50),
)


def _repeat_words(words: Column, window: int) -> tuple[Column, Column]:
    """Hashes of all windows, and from them the words in windows found twice or more (as an expression of "windows")."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return hashes, F.transform(F.sequence(F.lit(0), F.size("hashes") - window), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(window)]))


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words) per row.

    All counts are of the whole text; null counts as a text without words. A window is compared by a
    64-bit hash within its own text.
    """
    return _measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), window)


def _measured(rows: DataFrame, window: int = 5) -> DataFrame:
    """The same for (id, text), where an id may be anything that goes with a text."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    bare = F.trim("text", F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    rows = rows.select("id", words.alias("words"), lines.alias("lines"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    hashes, windows = _repeat_words(F.col("words"), window)
    rows = rows.select(
        "id", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        hashes.alias("hashes"),
    )
    rows = rows.withColumn("windows", F.when(F.col("n_words") >= window, windows))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    # most texts repeat no window and skip the sort
    placed = F.when(twice, F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    rows = rows.drop("hashes").withColumn("placed", placed)
    hits = F.filter("placed", lambda p, k: p["w"].eqNullSafe(F.when(k > 0, F.get("placed", k - 1))["w"]) | p["w"].eqNullSafe(F.get("placed", k + 1)["w"]))
    rows = rows.drop("windows").withColumn("hits", F.array_sort(F.transform(hits, lambda p: p["i"])))
    covered = F.aggregate(F.transform("hits", lambda at, k: F.least(F.lit(window), F.coalesce(F.get("hits", k + 1) - at, F.lit(window)))), F.lit(0), lambda a, b: a + b)
    counts = F.struct("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_stop_words")
    # as the rows of a generator of one row each: a filter on a count would else be pushed down and
    # unfold all expressions above into itself
    return rows.select("id", F.inline(F.array(counts)))


def _metrics() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "repeat_percent": 100 * F.col("n_repeat_words") / words,
        "symbol_percent": 100 * F.col("n_symbols") / words,
        "mean_word": F.col("word_chars") / words,
        "stop_percent": 100 * F.col("n_stop_words") / words,
        "dup_line_percent": 100 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def failures(thresholds: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """The names of the rules that a measured document fails."""
    metrics = _metrics()

    def fails(rule: Rule) -> Column:
        m = metrics[rule.metric]
        bounds = [m < rule.below] if rule.below is not None else []
        bounds += [m > rule.above] if rule.above is not None else []
        return F.when(reduce(Column.__or__, bounds) & (F.col("n_words") >= rule.words), F.lit(rule.name))

    return F.array_compact(F.array(*map(fails, thresholds)))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", thresholds: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The measures of each row, the failed rules and `kept` (none failed).

    Null and blank texts have no words and fail `few_words`. Ids may be null or repeat: rows are
    judged one by one. Other columns are ignored.
    """
    rows = measured(docs, id_col=id_col, text_col=text_col)
    return rows.withColumn("failed", failures(thresholds)).withColumn("kept", F.size("failed") == 0).withColumnRenamed("id", id_col)


def passing(docs: DataFrame, *, text_col: str = "text", thresholds: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows of `docs` that no rule fails, in one pass; rows are judged one by one."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _measured(docs.select(whole.alias("id"), F.col(text_col).alias("text")))
    return rows.filter(F.size(failures(thresholds)) == 0).select(*[F.col(f"id.`{c}`").alias(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


OP4_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
w AS (SELECT doc_id, k, array_to_string(words[k:k+4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM m)),
d AS (SELECT doc_id, k FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM d) GROUP BY doc_id),
r AS (SELECT m.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(list_filter(words, lambda x: x IN (STOPS))) AS n_stop FROM m LEFT JOIN c ON m.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words
    OR word_chars < 2 * n_words OR (n_words >= 20 AND word_chars > 12 * n_words)
    OR (n_words >= 50 AND 100 * n_stop < 3 * n_words) OR (n_lines > 0 AND 100 * n_dup_lines > 50 * n_lines)) AS kept FROM r
""".replace("STOPS", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
