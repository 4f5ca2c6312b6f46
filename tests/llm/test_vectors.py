import math
import random

import numpy as np
import pytest

from siltlog.llm import vectors
from siltlog.llm.components import components


def brute(rows, least=0.98):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float64)
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v, _ in rows]
    n, parent = [0] * len(rows), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[b] = a
    return {r[0]: (n[i], find(r[0])) for i, r in enumerate(rows)}


def made(count=600, near=120, seed=5):
    rng, rows = np.random.default_rng(seed), []
    heart = rng.normal(size=16)
    for k in range(count):
        v = heart + rng.normal(size=16) * rng.uniform(0.02, 0.12) if k < near else rng.normal(size=16)
        rows.append((k, np.float32(v).tolist(), int(rng.integers(0, 2))))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_against_brute_force(spark):
    rows = made()
    want = brute(rows)
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    links = sum(n for n, _ in want.values())
    assert links > 1000 and 0.9 * links <= sum(r["n_links"] for r in got.values()) <= links
    assert all(got[k]["n_links"] <= n for k, (n, _) in want.items())
    assert sum(got[k]["component_id"] == c for k, (_, c) in want.items()) >= 0.99 * len(rows)


def test_long_lists_are_compared_in_parts(spark, monkeypatch):
    rows = made(200, 200, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, vectors.near_vectors(frame, pivots=4).collect()))
    monkeypatch.setattr(vectors, "PART", 16)
    assert sorted(map(tuple, vectors.near_vectors(frame, pivots=4).collect())) == whole


def leaning(cosine, n=6000, wide=384, pairs=600, seed=8):
    """Unit vectors whose mean cosine is given; the last ones are at 0.982 to the first."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(cosine**0.5 * unit(rng.normal(size=(1, wide))) + (1 - cosine) ** 0.5 * unit(rng.normal(size=(n, wide))))
    g = rng.normal(size=(pairs, wide))
    g -= (g * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    return np.vstack([x, 0.982 * x[:pairs] + (1 - 0.982**2) ** 0.5 * unit(g)])


@pytest.mark.parametrize("cosine", [0, 0.8, 0.92, 0.95])
def test_leaning_vectors_meet_in_few_lists(cosine):
    x, pairs = leaning(cosine), 600
    some = np.random.default_rng(1).permutation(len(x))[:160].tolist()
    lists = vectors.Reference(x[some].tolist(), 80, 0.98).lists(x)
    numbers, n = np.unique(lists[lists != vectors.NONE], return_counts=True)
    assert (n * (n - 1) / 2).sum() < 0.25 * len(x) * (len(x) - 1) / 2
    shared = vectors._first_shared(lists[:pairs], lists[-pairs:]) < vectors.NEVER
    assert shared.mean() >= 0.9


def test_one_narrow_cone(spark):
    # all but a few vectors lie next to the mean, some of them on either side of it
    x = leaning(0.985, 300, 24, 40)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.float32(x))] + [(900 + k, v.tolist(), 0) for k, v in enumerate(np.float32(leaning(0, 20, 24, 5)))]
    want = brute(rows)
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    links = sum(n for n, _ in want.values())
    assert links > 10_000 and 0.95 * links <= sum(r["n_links"] for r in got.values()) <= links
    assert all(got[k]["n_links"] <= n for k, (n, _) in want.items())


def test_odd_vectors(spark):
    a = [1.0, 0.0, 0.5]
    rows = [(1, a, 0), (2, a, 0), (3, [2.0, 0.0, 1.0], 0), (4, a, 1), (5, a, None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0, 0.0], 0), (9, [1.0, None, 0.5], 0), (10, [1.0, float("nan"), 0.5], 0), (11, [1.0, float("inf"), 0.5], 0), (12, [1.0, -0.0, 0.5], 0), (13, [1.0, 0.0], 0), (14, [-1.0, 0.0, -0.5], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", node string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(frame).collect()}
    assert got == brute(rows) and got[1] == (3, 1)
    extra = vectors.near_vectors(spark.createDataFrame([(None, a, 0), (1, a, 0), (1, a, 0)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in extra) == [(0, 0, True), (1, 1, True), (1, 1, True)]
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + k, 100) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (3, 2), (None, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {k: find(k) for k in parent}
