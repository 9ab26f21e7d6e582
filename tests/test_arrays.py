import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.functions import arrays as A


def lits(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_softmax_and_argmax(one):
    values = [1.0, 3.0, 2.0, 1000.0]
    got, best, tie = one(A.softmax(lits(values)), A.argmax(lits(values)), A.argmax(lits([2, 2, 1])))
    e = np.exp(np.array(values) - 1000)
    assert np.allclose(got, e / e.sum())
    assert (best, tie) == (3, 0)


@pytest.mark.parametrize("t", [0.5, 1.0, 2.0])
def test_rescale_keeps_order(one, t):
    p = [0.2, 0.5, 0.0, 0.3]
    got = one(A.rescale(lits(p), t))[0]
    logs = [math.log(max(v, 1e-12)) / t for v in p]
    w = [math.exp(v - max(logs)) for v in logs]
    assert np.allclose(got, [v / sum(w) for v in w])
    assert np.argsort(got).tolist() == np.argsort(p).tolist()


def test_binary_scores_tie_is_yes(one):
    scores, probabilities, predicted = A.binary_scores(F.lit(0.5))
    assert list(one(scores, probabilities, predicted)) == [[0.0, 0.5], [0.5, 0.5], 1]


@pytest.mark.parametrize("count", [1, 2, 7, 8, 28, 29, 32])
def test_digest_bytes(one, count):
    got = one(A.digest_bytes(F.lit("質問"), count))[0]
    assert got == list(hashlib.sha256("質問".encode()).digest()[:count])


def test_numeric_options_invariants(spark):
    golds = ["0", "1", "-3", "2.5", "23", "100000", "0.5", "-0.25"]
    df = spark.createDataFrame([(g, f"i{n}") for n, g in enumerate(golds * 25)], "g string, id string")
    for count in (4, 10):
        rows = df.select("g", A.numeric_options(F.col("g"), count, 42, F.col("id")).alias("o")).collect()
        again = df.select(A.numeric_options(F.col("g"), count, 42, F.col("id")).alias("o")).collect()
        assert [r["o"] for r in rows] == [r["o"] for r in again]
        for row in rows:
            assert len(row["o"]) == count == len(set(row["o"]))
            assert row["o"].count(row["g"]) == 1


def test_numeric_options_reserve(one, monkeypatch):
    """With a single repeated draw the pools still provide enough distractors."""
    monkeypatch.setattr(A, "_draw", lambda gold, data, t: gold + 1.0)
    got = one(A.numeric_options(F.lit("5"), 10, 42, F.lit("x")))[0]
    assert len(set(got)) == 10 and "5" in got and "6" in got


def test_numeric_options_later_draws_only_where_needed(one, monkeypatch):
    """Draws after the first are computed only if these give too few distinct values, and then all count."""
    later = F.raise_error(F.lit("not needed")).cast("double")
    monkeypatch.setattr(A, "_draw", lambda gold, data, t: gold + float(t + 1) if t < 14 else later)
    got = one(A.numeric_options(F.lit("5"), 10, 42, F.lit("x")))[0]
    assert sorted(got, key=int) == [str(n) for n in range(5, 15)]
    monkeypatch.setattr(A, "_draw", lambda gold, data, t: gold + float(t // 3 + 1))
    got = one(A.numeric_options(F.lit("5"), 10, 42, F.lit("x")))[0]
    assert sorted(got, key=int) == [str(n) for n in range(5, 15)]


def test_seeded_shuffle(one):
    values = F.array(*[F.lit(v) for v in "abcd"])
    got = one(A.seeded_shuffle(values, 42, F.lit("k")))[0]
    assert got == sorted("abcd", key=lambda v: hashlib.sha256(f"42:k:{v}".encode()).hexdigest())


def test_vectors(one):
    x, y = [1.0, 2.0, -2.0], [0.5, 0.0, 4.0]
    row = one(
        A.dot(lits(x), lits(y)), A.l2_normalize(lits(x)), A.cosine(lits(x), lits(y)),
        A.layer_norm(lits(x)), A.mean_pool(F.array(lits(x), lits(y))),
    )
    a, b = np.array(x), np.array(y)
    assert row[0] == pytest.approx(a @ b)
    assert np.allclose(row[1], a / np.linalg.norm(a))
    assert row[2] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert np.allclose(row[3], (a - a.mean()) / np.sqrt(a.var() + 1e-5))
    assert np.allclose(row[4], (a + b) / 2)
