import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    own = sorted({(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in rows})
    out = []
    for q, qv in own:
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(qv, v)), i) for i, v in own if i != q]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [{}, {"unit": 150, "group": 7}])
def test_top_k_is_exact(spark, size, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(4)]) for i in range(500)]  # many ties
    rows += [(1000 + i, [0.5] * 4) for i in range(300)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + rows[:9]], SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, 20, **size).collect())
    assert got == brute(rows, 20)


def test_pruned_trees_agree_with_a_scan():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-9, 9, (900, 6)) + 40 * c for c in (-1, 0, 1)])
    ids, queries = rng.permutation(2700), rng.integers(-40, 40, (30, 6))
    for own, query, best in zip(range(30), queries, topk.search_unit(ids, points, np.arange(30), queries, 10)):
        scores = points @ query
        want = sorted(((int(s), -int(i)) for s, i in zip(scores, ids) if i != own), reverse=True)[:10]
        assert sorted(best, reverse=True) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan]), (4, [inf, 1.0]), (None, [1.0]), (5, [1.0]), (6, []), (20, [3.0, 0.0]), (20, [0.0, 1.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, 3).collect())
    assert got == sorted([
        (0, 1, 20, 192 * 64), (0, 2, 20, 64 * 128), (0, 3, 5, 64 * 64),
        (20, 1, 0, 192 * 64), (20, 2, 5, 192 * 64), (20, 3, 6, 0),
        (20, 1, 0, 64 * 128), (20, 2, 5, 0), (20, 3, 6, 0),
    ])
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
