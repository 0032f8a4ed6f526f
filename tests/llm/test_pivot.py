import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import pivot_search
from colloquy.llm.pivot_search import centres, exact_top_k, first_copies


def plainly(rows, asks, k, scale=256):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(scale * x) for x in v])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q in good:
        if asks(q):
            scored = sorted((-max(dot(a, b) for a in good[q] for b in good[c]), c) for c in good if c != q)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, every=7, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted(map(tuple, exact_top_k(df, F.col("vec_id") % every == 0, **more).collect()))


@pytest.mark.parametrize("kind", ["clusters", "lengths", "copies"])
def test_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(pivot_search, "RING", 20)
    monkeypatch.setattr(pivot_search, "QUERIES", 8)
    rng = np.random.default_rng(3)
    mid = rng.normal(size=(6, 8))
    x = mid[rng.integers(0, 6, 400)] + 0.1 * rng.normal(size=(400, 8))
    if kind == "lengths":
        x *= rng.lognormal(0, 1.5, size=(400, 1))
    if kind == "copies":
        x[100:300] = x[7]
        x = np.round(x)
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    assert search(spark, rows, pivots=5, sample=200) == plainly(rows, lambda q: q % 7 == 0, 5)


def test_edges(spark):
    random.seed(1)
    odd = [(0, [1.0, 2.0]), (7, None), (14, [None, 1.0]), (21, [float("nan"), 1.0]), (28, [float("inf"), 1.0]), (None, [9.0, 9.0]), (35, []), (42, [0.5]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [-1.0, 5.0]), (49, [3.0, 0.0]), (49, [0.0, 3.0]), (2, [-2.0, -2.0]), (3, [1e4, -1e4])]
    assert search(spark, odd) == plainly(odd, lambda q: q % 7 == 0, 5)
    assert search(spark, odd[:1]) == [] and search(spark, []) == [] and search(spark, odd[1:4]) == []
    assert search(spark, [(0, [0.0]), (5, [0.0]), (3, [0.0])], k=1) == [(0, 1, 3, 0)]
    big = [(0, [3e7, 1.0]), (1, [3e7, 0.5]), (2, [3e7, 0.75])]
    assert search(spark, big, k=2, scale=1) == plainly(big, lambda q: q % 7 == 0, 2, 1)
    with pytest.raises(ValueError, match="long"):
        search(spark, [(0, [1e12]), (1, [1e12])])
    wide = spark.createDataFrame([(0, [1.0], 1, 2, "x"), (1, [2.0], 1, 2, "y")], "vec_id long, embedding array<float>, id int, v int, rank string")
    assert list(map(tuple, exact_top_k(wide, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 131072)]


def test_bounds_leave_rings_out(spark, monkeypatch):
    """Far clusters are not searched: the triangle inequality leaves their rings out."""
    monkeypatch.setattr(pivot_search, "RING", 20)
    monkeypatch.setattr(pivot_search, "QUERIES", 4)
    rng = np.random.default_rng(4)
    mid = 5 * np.eye(8)
    x = np.repeat(mid, 50, axis=0) + 0.02 * rng.normal(size=(400, 8))
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    pairs = []
    real = pivot_search.save
    monkeypatch.setattr(pivot_search, "save", lambda df, label: (lambda out: (pairs.append(out[0].count()) if label == "pairs" else None, out)[1])(real(df, label)))
    assert search(spark, rows, every=50, pivots=8, sample=400) == plainly(rows, lambda q: q % 50 == 0, 5)
    rings = 8 * 3
    assert 8 <= sum(pairs) < 8 * rings / 3


def test_helpers():
    x = np.array([[1, 1], [2, 2], [1, 1], [1, 1], [2, 2]], dtype="int16")
    assert sorted(first_copies(x, np.array([5, 1, 3, 3, 1]), 1).tolist()) in ([1, 2], [1, 3])
    assert len(centres(np.array([[0.0], [0.0], [4.0]]), 5)) == 2
