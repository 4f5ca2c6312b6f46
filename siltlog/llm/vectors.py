"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltlog.llm.components import components
from siltlog.llm.shared import stored

#: Pivots that two vectors share at least to be compared.
SHARED = 2
#: Vectors of a list that one task compares with each other or with as many of another part.
PART = 1024
#: Most pivots, taken from a sample of twice as many vectors.
MOST_PIVOTS = 1024
#: Share of planted pairs (PLANTED or more) that must meet in a list, and the most nearest pivots that are tried for it.
ENOUGH, PLANTED, MOST_NEAREST = 0.97, 1000, 16
#: List of the vectors next to the centre, no list, and a number above all lists.
CENTRE, NONE, NEVER = 0, -1, np.iinfo(np.int32).max


def _rows(column: pa.Array) -> np.ndarray:
    """A matrix of the vectors of a column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _unit(x: np.ndarray) -> np.ndarray:
    return _scaled(x / np.abs(x).max(axis=1, keepdims=True))  # squares of tiny and huge components stay finite


class Reference:
    """Reference points, seen from the mean of a sample, and the lists that a vector enters by the order of its nearest ones.

    Vectors that lean to one side differ little in direction, so they are described after the mean is
    taken away. How many nearest points describe a vector is found by planting: each vector of the
    sample that is no such point gets partners whose cosine is just `least`, and the number rises until ENOUGH of these
    pairs meet in a list, so narrow cones cost more lists, not recall. Vectors no farther from the
    mean than linked ones are from each other also enter one list of their own.
    """

    def __init__(self, points: list[list[float]], most: int, least: float) -> None:
        width = max(map(len, points))
        sample = _unit(np.array([[*p, *[0.0] * (width - len(p))] for p in points], np.float64))
        self.centre, self.inner = sample.mean(axis=0), 1 - least
        seen = _scaled(sample - self.centre)
        found = self._farthest(seen, most)
        self.pivots = seen[found] if len(found) >= SHARED else np.vstack([seen[found], -seen[found]])
        others = np.setdiff1d(np.arange(len(sample)), found)
        sample = sample[np.resize(others if len(others) else found, max(PLANTED, len(others)))]
        aside = np.random.default_rng(7).normal(size=sample.shape)
        aside = _scaled(aside - (aside * sample).sum(axis=1, keepdims=True) * sample)
        planted = least * sample + max(1 - least * least, 0.0) ** 0.5 * aside
        for self.nearest in range(min(SHARED + 1, len(self.pivots)), min(MOST_NEAREST, len(self.pivots)) + 1):
            #: Places in the order of the nearest points that make a list: the nearer one, the farther may the other be.
            self.places = [(i, j) for i, j in combinations(range(self.nearest), SHARED) if i + j < max(self.nearest, SHARED)]
            if (_first_shared(self.lists(sample), self.lists(planted)) < NEVER).mean() >= ENOUGH:
                break

    @staticmethod
    def _farthest(sample: np.ndarray, most: int) -> list[int]:
        """Places of the points. Each next one is the one farthest from those before; the first is the farthest from the first of the sample."""
        found = [int(np.argmin(sample @ sample[0]))]
        near = sample @ sample[found[0]]
        while len(found) < most and near.min() < 1 - 1e-6:
            found.append(int(np.argmin(near)))
            near = np.maximum(near, sample @ sample[found[-1]])
        return found

    def lists(self, unit: np.ndarray) -> np.ndarray:
        """Numbers of the lists of each vector; the last is CENTRE or NONE. Vectors of another length are cut or filled with 0."""
        k = min(unit.shape[1], len(self.centre))
        left = unit[:, :k] - self.centre[:k]
        near = _scaled(left) @ self.pivots[:, :k].T
        order = np.argsort(-near, axis=1, kind="stable")[:, : self.nearest].astype(np.int32)
        n = len(self.pivots)
        made = [1 + np.minimum(order[:, i], order[:, j]) * n + np.maximum(order[:, i], order[:, j]) for i, j in self.places]
        inner = (left * left).sum(axis=1) <= self.inner
        return np.stack([*made, np.where(inner, CENTRE, NONE)], axis=1).astype(np.int32)


def _described(batches: Iterable[pa.RecordBatch], reference: Reference) -> Iterator[pa.RecordBatch]:
    """Adds the numbers of the lists of each vector."""
    for batch in batches:
        found = np.full((batch.num_rows, len(reference.places) + 1), NONE, np.int32)
        sizes = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            some = np.flatnonzero(sizes == d)
            for at in range(0, len(some), 2048):
                part = some[at : at + 2048]
                found[part] = reference.lists(_unit(_rows(batch.column(3).take(pa.array(part)))))
        column = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "lists"])


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of list numbers, the smallest that both have."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a != NONE)
    return np.where(both, a, NEVER).min(axis=1)


def _links(ids: np.ndarray, weights: np.ndarray, unit: np.ndarray, lists: np.ndarray, side: np.ndarray, key: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one list or of two parts of it: counts for each vector, and the smallest linked place of each group.

    A pair that several lists hold is counted in the smallest of them only.
    """
    n = len(ids)
    counts, linked = np.zeros(n, np.int64), np.zeros((n, n), bool)
    two = side.min() != side.max()
    for at in range(0, n, 256):
        near = unit[at : at + 256] @ unit.T >= least
        i, j = np.nonzero(near)
        i += at
        keep = (i < j) & ((side[i] != side[j]) if two else True)
        i, j = i[keep], j[keep]
        linked[i, j] = linked[j, i] = True
        for lo in range(0, len(i), 50_000):
            a, b = i[lo : lo + 50_000], j[lo : lo + 50_000]
            own = _first_shared(lists[a], lists[b]) == key
            np.add.at(counts, a[own], weights[b[own]])
            np.add.at(counts, b[own], weights[a[own]])
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        least_label = np.where(linked, label[None, :], n).min(axis=1)
        if (least_label == label).all():
            return counts, label
        label = least_label


def _compared(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Sorted rows (group, id, weight, vector, lists, list, side): the rows of a group follow each other."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        groups = table.column("group").to_numpy()
        if not len(groups):
            return
        ids, weights = table.column("id").to_pylist(), table.column("weight").to_numpy()
        sizes = pc.list_value_length(table.column("vector")).to_numpy()
        unit = np.zeros((len(groups), int(sizes.max())))
        for d in np.unique(sizes):
            some = np.flatnonzero(sizes == d)
            unit[some, :d] = _unit(_rows(table.column("vector").take(pa.array(some)).combine_chunks()))
        lists = table.column("lists").combine_chunks().flatten().to_numpy().reshape(len(groups), -1)
        own, side = (table.column(c).to_numpy() for c in ("list", "side"))
        edges = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        a: list = []
        b: list = []
        n: list = []
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(groups)], strict=True):
            if hi - lo < 2:
                continue
            counts, label = _links(np.arange(hi - lo), weights[lo:hi], unit[lo:hi], lists[lo:hi], side[lo:hi], int(own[lo]), least)
            for k in np.flatnonzero(counts).tolist():
                a.append(ids[lo + k]), b.append(None), n.append(int(counts[k]))
            for k in np.flatnonzero(label != np.arange(hi - lo)).tolist():
                a.append(ids[lo + k]), b.append(ids[lo + int(label[k])]), n.append(None)
        kind = table.schema.field("id").type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(n, pa.int64())], ["a", "b", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        # the last group may go on in the next batch
        groups = batch.column(0).to_numpy()
        cut = int(np.searchsorted(groups, groups[-1], "left")) if (groups[:-1] <= groups[1:]).all() else 0
        held.append(batch.slice(0, cut))
        if cut:
            yield from done(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from done(pa.Table.from_batches(held))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, pivots: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) per row: vectors of one label whose cosine is `least` or more are linked.

    Equal vectors of a label form a class. A class is described by the order of its nearest pivots and
    enters the inverted lists of two of them whose ranks add up to little; classes that meet in a list share SHARED pivots near the front of both
    orders and are compared. Long lists are dealt into parts of about PART vectors, and parts are
    compared by twos, so a list of any length is compared whole. Links are counted where they are
    found and never listed: what leaves a list is a count for each vector and a spanning tree of each
    linked group.

    The reference points are the farthest from each other of the 2 * `pivots` vectors of smallest id
    hash, seen from their mean (`Reference`); `pivots` is by default the square root of the class
    count, at least 32 and at most MOST_PIVOTS.

    A vector that is null, empty or zero, or holds a null or a non-finite component, a null label and
    a null id link with nothing. Vectors of different lengths are not linked. Rows that repeat an id
    are vectors of their own in the counts and one node in the components.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    # 0 + 0.0 makes a negative zero positive
    usable = rows.filter(good).select("id", "label", F.transform("vector", lambda x: x + F.lit(0).cast("float")).alias("vector"))
    classes = stored(usable.groupBy("label", "vector").agg(F.min("id").alias("node"), F.count("*").alias("weight")).select("node", "label", "weight", "vector"), "vector-classes")
    n = classes.count()
    wanted = pivots or max(32, min(MOST_PIVOTS, int(n**0.5)))
    points = [r[0] for r in classes.orderBy(F.xxhash64("node"), "node").limit(2 * wanted).select("vector").collect()]
    if n > 1:
        reference = Reference(points, wanted, least)
        described = classes.mapInArrow(lambda it: _described(it, reference), T.StructType([*classes.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))]))
        described = described.withColumn("d", F.size("vector"))
        entered = F.explode(F.filter("lists", lambda x: x != NONE)).alias("list")
        listed = described.select("*", entered)
        sizes = described.select("label", "d", entered).groupBy("label", "d", "list").agg(F.count("*").alias("in_list")).filter("in_list > 1")
        listed = listed.join(sizes, ["label", "d", "list"])
        parts = F.ceil(F.col("in_list") / PART)
        listed = listed.withColumn("side", F.pmod(F.xxhash64("node", F.lit(3)), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        group = F.xxhash64("label", "d", "list", F.least("side", "other"), F.greatest("side", "other"))
        listed = listed.select(group.alias("group"), F.col("node").alias("id"), "weight", "vector", "lists", "list", "side")
        sorted_ = listed.repartition("group").sortWithinPartitions("group")
        found = sorted_.mapInArrow(lambda it: _compared(it, least), f"a {kind}, b {kind}, n long")
        found = stored(found, "vector-links")
        more = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
        linked = components(found.filter("n is null").select("a", "b")).select(F.col("id").alias("node"), "component")
    else:
        more = linked = None
    members = usable.join(classes.withColumnRenamed("node", "of"), ["label", "vector"]).select("id", F.col("of").alias("node"), (F.col("weight") - 1).alias("copies"))
    if more is not None:
        members = members.join(more, "node", "left").join(linked, "node", "left")
    else:
        members = members.withColumn("more", F.lit(0)).withColumn("component", F.col("node"))
    members = members.select("id", (F.col("copies") + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    lonely = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = members.unionByName(lonely)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
