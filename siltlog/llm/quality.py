"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm import words
from siltlog.llm.rules import STOP_WORDS
from siltlog.llm.shared import join_group, stored

#: Labelled rows that the classifier is fitted on at most, those of smallest hash of id and text.
LABELLED = 2_000
#: Paths whose posteriors are sent to every executor at most; beyond that they are shuffled.
SENT_PATHS = 200_000
#: Buckets for hashed runs of three bytes, and as many for hashed words and word pairs.
GRAMS = 1 << 12
#: Counts of a text's surface, each cut into BINS at the quantiles of the fitting rows, and the weight of a bin beside the n-grams.
SURFACE = ("log_words", "symbols", "capitals", "digits", "shouts", "stop_words", "distinct", "repeated_lines", "word_bytes", "sentence_ends")
BINS, BIN_WEIGHT = 8, 0.7
#: Rows that are counted together.
_ROWS = 64


def _marks(characters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(characters, np.uint8))


_KINDS = [_marks(b"#*$%&|<>=_{}[]\\^~"), _marks(bytes(range(65, 91))), _marks(b"0123456789"), _marks(b"!")]
_ENDING = _marks(b".?!")
_STOPS = np.sort(words.word_hashes(pa.array([" ".join(STOP_WORDS)]))[0])


def _repeated_lines(text: str | None) -> float:
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return 1 - len(set(lines)) / len(lines) if lines else 0.0


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of rows: entries of a row, their buckets and values end to end, and the SURFACE of each row.

    A value is log(1 + count) of a bucket of n-grams, scaled so that a row has length one. Null counts as empty.
    """
    data, offsets = words.flat(column)
    hashes, before = words.word_hashes(column)
    width = 2 * GRAMS
    for at in range(0, len(column), _ROWS):
        n = min(_ROWS, len(column) - at)
        counts, marks, endings, stops = np.zeros(n * width, np.int64), np.zeros((n, len(_KINDS))), np.zeros(n), np.zeros(n)
        ends = offsets[at + 1 : at + n + 1]
        for lo in range(int(offsets[at]), int(ends[-1]), words.PART):  # bytes
            hi = min(int(ends[-1]), lo + words.PART)
            row = np.searchsorted(ends, np.arange(lo, hi), "right")
            some = np.zeros(hi - lo + 2, np.uint32)
            some[: min(hi + 2, len(data)) - lo] = data[lo : hi + 2]
            left = ends[row] - np.arange(lo, hi)
            code = ((some[:-2] | some[1:-1] << np.uint32(8) | some[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
            whole = left > 2
            counts += np.bincount(row[whole] * width + code[whole], minlength=n * width)
            for k, kind in enumerate(_KINDS):
                marks[:, k] += np.bincount(row[kind[data[lo:hi]]], minlength=n)
            last = _ENDING[data[lo:hi]] & ((left == 1) | words.BLANK[some[1:-1]])
            endings += np.bincount(row[last], minlength=n)
        after = before[at + 1 : at + n + 1]
        for lo in range(int(before[at]), int(after[-1]), words.PART // 8):  # words
            hi = min(int(after[-1]), lo + words.PART // 8)
            row, some = np.searchsorted(after, np.arange(lo, min(hi + 1, int(after[-1]))), "right"), hashes[lo : min(hi + 1, int(after[-1]))]
            two = np.flatnonzero(row[1:] == row[:-1])
            pairs = words.mix(some[two] * np.uint64(3) + some[two + 1]) >> np.uint64(52)
            counts += np.bincount(row[two] * width + GRAMS + pairs.astype(np.int64), minlength=n * width)
            row, some = row[: hi - lo], some[: hi - lo]
            counts += np.bincount(row * width + GRAMS + (some >> np.uint64(52)).astype(np.int64), minlength=n * width)
            stops += np.bincount(row[np.isin(some, _STOPS)], minlength=n)
        held = np.flatnonzero(counts)
        row, value = held // width, np.log1p(counts[held])
        value /= np.sqrt(np.bincount(row, value * value, minlength=n))[row]
        total, size = np.diff(before[at : at + n + 1]), np.diff(offsets[at : at + n + 1])
        per_word, per_byte = np.maximum(total, 1), np.maximum(size, 1)
        distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(before[at : at + n], after, strict=True)])
        repeated = np.array([_repeated_lines(t) for t in column.slice(at, n).to_pylist()])
        surface = np.column_stack([np.log1p(total), marks[:, 0] / per_word, marks[:, 1] / per_byte, marks[:, 2] / per_byte, marks[:, 3] / per_word, stops / per_word, distinct / per_word, repeated, size / per_word, endings / per_word])
        yield np.bincount(row, minlength=n), held % width, value, surface


class Model:
    """Logistic regression over hashed n-grams and binned surface counts."""

    def __init__(self, sizes: np.ndarray, buckets: np.ndarray, values: np.ndarray, surface: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 80) -> None:
        self.cuts = [np.unique(np.quantile(surface[:, k], np.arange(1, BINS) / BINS)) if len(y) else np.zeros(0) for k in range(len(SURFACE))]
        self.grams, self.bins, self.bias = np.zeros(2 * GRAMS), np.zeros((len(SURFACE), BINS)), 0.0
        if not len(y):
            return
        bins, ends = self._binned(surface), np.concatenate([[0], np.cumsum(sizes)])
        number = bins + np.arange(len(SURFACE)) * BINS
        # accelerated gradient; each row's squared length with the bias is the bound of the step
        pace = 4 / (2 + len(SURFACE) * BIN_WEIGHT**2)
        last = (self.grams, self.bins, self.bias)
        for k in range(steps):
            down, miss = np.zeros(len(self.grams)), np.zeros(len(y))
            for at in range(0, len(y), 256):  # rows at a time: their entries are wide numbers only here
                some, held = slice(at, at + 256), slice(ends[at], ends[min(at + 256, len(y))])
                row, places, weights = np.repeat(np.arange(len(sizes[some])), sizes[some]), buckets[held].astype(np.int64), values[held].astype(np.float64)
                miss[some] = (y[some] - self._squash(self._margins(sizes[some], row, places, weights, bins[some]))) / len(y)
                down += np.bincount(places, weights * miss[some][row], minlength=len(down))
            some = np.bincount(number.ravel(), np.repeat(miss, len(SURFACE)) * BIN_WEIGHT, minlength=self.bins.size).reshape(self.bins.shape)
            new = (self.grams + pace * (down - ridge * self.grams), self.bins + pace * (some - ridge * self.bins), self.bias + pace * miss.sum())
            self.grams, self.bins, self.bias = (a + k / (k + 3) * (a - b) for a, b in zip(new, last, strict=True))
            last = new
        self.grams, self.bins, self.bias = last

    def _binned(self, surface: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(cuts, surface[:, k], "left") for k, cuts in enumerate(self.cuts)])

    def _margins(self, sizes, row, buckets, values, bins) -> np.ndarray:
        return self.bias + np.bincount(row, values * self.grams[buckets], minlength=len(sizes)) + BIN_WEIGHT * self.bins[np.arange(len(SURFACE)), bins].sum(axis=1)

    @staticmethod
    def _squash(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def probability(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for sizes, buckets, values, surface in features(column):
            out.append(self._squash(self._margins(sizes, np.repeat(np.arange(len(sizes)), sizes), buckets, values, self._binned(surface))))
        return np.concatenate(out)


def _packed(column: pa.Array) -> Iterator[bytes]:
    """The features of each row as one value: surface, buckets, values."""
    press = zstandard.ZstdCompressor(level=1)
    for sizes, buckets, values, surface in features(column):
        at = 0
        for k, size in enumerate(sizes.tolist()):
            yield press.compress(surface[k].tobytes() + buckets[at : at + size].astype("<u2").tobytes() + values[at : at + size].astype("<f2").tobytes())
            at += size


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """A model of label 1 against 0, fitted on at most `labelled` rows; null ids and labels are left out.

    An id with several labels has their mean; each row of a labelled id counts, in order of the hash
    of id and text. With no labelled row the model gives one half for every text.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
    rows = rows.groupBy("id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(labelled)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id")

    @F.arrow_udf("binary")
    def packed(text: pa.Array) -> pa.Array:
        return pa.array(_packed(text), pa.binary())

    found = found.select("y", F.xxhash64("id", "text").alias("h"), packed("text").alias("x")).orderBy("h").limit(labelled)
    unpack, wide = zstandard.ZstdDecompressor(), 8 * len(SURFACE)
    y, surface, buckets, values = [], [], [], []
    for row in found.toLocalIterator():
        x = unpack.decompress(row["x"])
        n = (len(x) - wide) // 4
        y.append(row["y"])
        surface.append(x[:wide])
        buckets.append(x[wide : wide + 2 * n])
        values.append(x[wide + 2 * n :])
    sizes = np.array([len(b) // 2 for b in buckets], np.int64)
    counts = np.frombuffer(b"".join(surface)).reshape(len(y), len(SURFACE))
    return Model(sizes, np.frombuffer(b"".join(buckets), "<u2"), np.frombuffer(b"".join(values), "<f2"), counts, np.array(y))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, model: Model, *, text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, without: Iterable[str] = ()) -> DataFrame:
    """The columns of `docs` but those of `without`, with doc_score, host_score, path_score, quality and kept (an input column so named is replaced).

    A host's score is the mean of its documents' scores, drawn to the mean of all by a prior whose
    weight comes from how much hosts differ; a path's (host and path column) is drawn to its host's
    in the same way. Both leave the document itself out, whose score is evidence of its own: with no
    other document in its path it has its host's score, with none in its host the mean of all.
    `quality` adds the path's log odds against the mean of all to the document's.
    Texts are scored once: the rows with their scores are written before they are grouped.

    Null and empty texts are scored as texts without words; null hosts and paths are a host and a
    path. Every row counts; rows may repeat. No rows in, no rows out.
    """
    made = ["doc_score", "host_score", "path_score", "quality", "kept"]
    names = [c for c in docs.columns if c not in (*made, *without)]

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        found = pa.array(model.probability(text))
        pa.default_memory_pool().release_unused()
        return found

    row = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in names])
    rows = docs.select(row.alias("row"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), scored(text_col).alias("doc_score"))
    rows = stored(rows, "scored")
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("doc_score").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    def prior(groups: DataFrame) -> tuple[float, float]:
        """Mean of all, and the weight of a Beta prior by the moments of the group means."""
        r = groups.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("g"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
        if not r["n"]:
            return 0.5, 1.0
        mean = r["s"] / r["n"]
        within = max(mean * (1 - mean), 1e-9)
        spread = (r["q"] - r["n"] * mean**2 - (r["g"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1.0)
        return mean, min(max(within / spread - 1, 1.0), 1e6) if spread > 0 else 1e6

    mean, host_weight = prior(hosts)
    _, path_weight = prior(paths)
    hosts = hosts.select(F.col("host").alias("of"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).select(F.struct("host", "path").alias("site"), "n", "s", "host_n", "host_s")
    paths = stored(paths, "sites")
    joined = join_group(rows, paths, F.struct("host", "path").eqNullSafe(F.col("site")), SENT_PATHS, F.monotonically_increasing_id())
    others = lambda total: F.greatest(F.col(total) - F.col("doc_score"), F.lit(0.0))
    joined = joined.withColumn("host_score", (others("host_s") + host_weight * mean) / (F.col("host_n") - 1 + host_weight))
    joined = joined.withColumn("path_score", (others("s") + path_weight * F.col("host_score")) / (F.col("n") - 1 + path_weight))
    quality = 1 / (1 + F.exp(-(_logit(F.col("doc_score")) + _logit(F.col("path_score")) - _logit(F.lit(mean)))))
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "doc_score", "host_score", "path_score", quality.alias("quality"), (quality >= threshold).alias("kept"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs.select("doc_id", "text", "source", "lang"), model, without=("text", "source", "lang"))
