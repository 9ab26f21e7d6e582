import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, k=10, low=30, high=90, every=100):
    own = sorted({(i, n, tuple(int(math.floor(256 * float(np.float32(x)))) for x in v)) for i, v, n in rows})
    out = []
    for a, label, av in own:
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(av, v)), i, n) for i, n, v in own if i != a]
        for p, pos, _ in sorted(s for s in scores if s[2] == label)[:positives]:
            inside = [(s, i) for s, i, n in sorted(scores) if n != label and low * -p <= 100 * -s <= high * -p]
            out += [(a, pos, at + 1, i, -p, -s) for at, (s, i) in enumerate(inside[:k])]
    return sorted(out)


def mined(table, **options):
    got = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("size", [{}, {"unit": 90, "group": 2}])
def test_hot_label_ties_and_repeats(spark, size):
    rng = random.Random(3)
    # A third of the rows has one label, and few different values give many ties.
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], 0 if i % 3 else rng.randrange(1, 5)) for i in range(700)]
    rows += [(700 + i, [0.5, 0.5, 0.5, 0.25], 2) for i in range(200)]
    table = spark.createDataFrame(rows + rows[:40], SCHEMA).withColumn("slot", F.lit("x")).withColumn("h", F.lit("x"))
    want = brute(rows)
    assert len({r[0] for r in want}) == 9 and mined(table, **size) == want


def test_few_rows_and_other_bounds(spark):
    rng = random.Random(4)
    rows = [(i * 50, [rng.uniform(-1, 1) for _ in range(8)], i % 4) for i in range(12)]
    table = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"positives": 2, "k": 1, "low": 0, "high": 100}, {"low": 50, "high": 50}):
        assert mined(table, **options) == brute(rows, **options)
    with pytest.raises(ValueError):
        negatives.hard_negatives(table, F.lit(True), low=90, high=30)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (100, [-1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5], 2), (3, [0.5, 0.25], 2), (4, None, 2), (5, [None], 2),
        (6, [nan, 1.0], 2), (7, [0.0, -inf], 2), (8, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (9, [], 2), (0, [0.5, 0.0], 3),
        (0, [0.5, 0.0], 3), (10, [1.0, 0.0], 3),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    # (0, label 1): positive 1 of 256 * 384, 100 is negative; (0, label 3): positive 10 of 128 * 256.
    assert mined(table) == [
        (0, 1, 1, 10, 98304, 65536), (0, 1, 2, 3, 98304, 49152), (0, 1, 3, 2, 98304, 32768), (0, 10, 1, 2, 32768, 16384), (0, 10, 2, 3, 32768, 16384),
    ]
    assert mined(table.limit(0)) == []


def test_slots_split_scores():
    uppers = np.array([90, 50, 50 - 1, 10])
    assert negatives.slots_of(np.array([91, 90, 51, 50, 49, 11, 10, -5]), uppers).tolist() == [-1, 0, 0, 1, 2, 2, 3, 3]
    assert negatives.first(np.array([5, 7, 7, 1, 7]), np.array([0, 1, 2, 4]), 2).tolist() == [1, 2]
