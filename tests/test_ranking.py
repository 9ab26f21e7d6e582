import hashlib

import pytest
from pyspark.sql import functions as F

from gavel.operators import ranking as R


def skewed(spark, n=300):
    """A group that holds most rows, a small and a single one."""
    key = F.when(F.col("id") < n - 8, "big").when(F.col("id") < n - 1, "small").otherwise("one")
    return spark.range(n).select(key.alias("k"), F.concat(F.lit("i"), "id").alias("id"), F.col("id").alias("n"))


def order_of(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i))


def test_hash_rank_is_a_whole_order(spark):
    rows = R.hash_rank(skewed(spark), ["k"], "id", hex_digits=1).collect()
    for key in ("big", "small", "one"):
        group = sorted((r for r in rows if r["k"] == key), key=lambda r: r["rank"])
        assert [r["id"] for r in group] == order_of([r["id"] for r in group])
        assert [r["rank"] for r in group] == list(range(1, len(group) + 1))
        assert {r["group_size"] for r in group} == {len(group)}


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, "a"), ("x", "b"), (None, "c")], "k string, id string")
    rows = R.hash_rank(df, ["k"], "id").collect()
    assert sorted((r["k"] or "", r["rank"], r["group_size"]) for r in rows) == [
        ("", 1, 2), ("", 2, 2), ("x", 1, 1)
    ]


@pytest.mark.parametrize("n,folds", [(23, 5), (10, 2), (5, 5)])
def test_kfold_partitions(spark, n, folds):
    df = spark.range(n).select(F.col("id").cast("string").alias("id"))
    rows = R.kfold(df, folds).collect()
    sizes = [sum(r["fold"] == f for r in rows) for f in range(folds)]
    assert len(rows) == n and sizes == [n // folds + (f < n % folds) for f in range(folds)]
    assert sorted(rows) == sorted(R.kfold(df, folds).collect())
    splits = R.fold_splits(R.kfold(df, folds), folds)
    assert splits.filter("split = 'val'").count() == n
    assert splits.filter("split = 'train'").count() == n * (folds - 1)


def test_kfold_rejects(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("id"))
    with pytest.raises(ValueError):
        R.kfold(df, 1)
    with pytest.raises(Exception, match="fewer items"):
        R.kfold(df, 4).collect()


def test_holdout(spark):
    rows = R.holdout(skewed(spark), 0.1, ["k"]).collect()
    val = {k: sum(r["split"] == "val" for r in rows if r["k"] == k) for k in ("big", "small", "one")}
    assert val == {"big": 29, "small": 1, "one": 0}
    rows = R.holdout(skewed(spark), 0.1, ["k"], keep_single=False).collect()
    assert sum(r["split"] == "val" for r in rows if r["k"] == "one") == 1
    assert {r["split"] for r in R.holdout(skewed(spark), 0.0, ["k"]).collect()} == {"train"}


def test_top_per_group_and_smoke(spark):
    df = skewed(spark)
    top = R.limit_per_dataset(df, 5, "n", "k").collect()
    assert sorted(r["n"] for r in top if r["k"] == "big") == [0, 1, 2, 3, 4]
    assert sum(r["k"] == "one" for r in top) == 1
    smoke = R.smoke_limit(df, {"big": 2, "small": None}, 4, "n", "k").collect()
    counts = {k: sum(r["k"] == k for r in smoke) for k in ("big", "small", "one")}
    assert counts == {"big": 2, "small": 4, "one": 1}


def test_first_wins(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, None), ("b", 3, "only")], "k string, o int, v string")
    assert sorted(tuple(r) for r in R.first_wins(df, ["k"], "o").collect()) == [("a", 1, None), ("b", 3, "only")]


def test_seeded_sample(spark):
    df = spark.range(60).select(F.col("id").alias("o"), (F.col("id") % 20).cast("string").alias("p"))
    got = R.seeded_sample(df, "p", 7, "o").collect()
    assert [r["p"] for r in got] == order_of([str(i) for i in range(20)])[:7]
    assert all(r["o"] < 20 for r in got)


def test_score_rank(spark):
    scores = [("a", 0.5), ("b", 0.9), ("c", None), ("d", 0.5), ("e", 0.90001), ("f", 0.0)]
    got = R.score_rank(spark.createDataFrame(scores, "m string, s double"), "s", "m").collect()
    assert [r["m"] for r in sorted(got, key=lambda r: r["rank"])] == ["e", "b", "a", "d", "c", "f"]
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5, 6]
