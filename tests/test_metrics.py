import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.operators import metrics as M
from gavel.operators import percentiles as P

SCHEMA = (
    "model string, dataset string, task string, id string, gold_index int, predicted_index int, "
    "probabilities array<double>, latency_ms double, "
    "score_metadata struct<usage: struct<input_tokens: bigint, output_tokens: bigint>>"
)


def rows(task, pairs, probabilities=None, latency=None, usage=None):
    return [
        ("m", "d", task, str(i), g, p, probabilities[i] if probabilities else None,
         float(latency[i]) if latency else 1.0, (usage[i] if usage else None,))
        for i, (p, g) in enumerate(pairs)
    ]


def summary(spark, data):
    return M.summarize(spark.createDataFrame(data, SCHEMA)).first()


def test_perfect_calibration(spark):
    s = summary(spark, rows("choice", [(0, 0), (1, 1)], [[1.0, 0.0], [0.0, 1.0]]))
    assert (s["nll"], s["brier_score"], s["ece"]) == (0, 0, 0)
    assert s["f1"] is None and s["mae"] is None


def test_missing_probabilities_mean_no_calibration(spark):
    s = summary(spark, rows("choice", [(0, 0), (1, 1)], [[1.0, 0.0], None]))
    assert s["accuracy"] == 1.0 and s["nll"] is None and s["ece"] is None


def test_binary(spark):
    s = summary(spark, rows("noul", list(zip([1, 1, 0, 0], [1, 0, 1, 0]))))
    assert (s["precision"], s["recall"], s["f1"]) == (0.5, 0.5, 0.5)
    s = summary(spark, rows("noul", [(0, 0), (0, 0)]))
    assert (s["precision"], s["recall"], s["f1"]) == (0, 0, 0)
    with pytest.raises(Exception, match="binary indices"):
        summary(spark, rows("noul", [(2, 0)]))
    with pytest.raises(Exception, match="unsupported task_type"):
        summary(spark, rows("other", [(0, 0)]))


def test_ordinal_perfect_and_constant(spark):
    s = summary(spark, rows("score", [(i, i) for i in range(4)]))
    assert [s[c] for c in ("mae", "rmse", "spearman", "quadratic_weighted_kappa",
                           "normalized_quadratic_weighted_kappa")] == [0, 0, 1, 1, 1]
    s = summary(spark, rows("score", [(0, 0), (0, 0)]))
    assert s["quadratic_weighted_kappa"] == 1.0 and s["spearman"] == 0.0
    s = summary(spark, rows("score", [(2, 2), (2, 2)]))
    assert s["quadratic_weighted_kappa"] == 1.0


def test_usage(spark):
    s = summary(spark, rows("choice", [(0, 0), (0, 0)], usage=[(12, 2), (8, 1)]))
    assert (s["input_tokens"], s["output_tokens"], s["total_tokens"], s["mean_tokens_per_item"]) == (20, 3, 23, 11.5)
    s = summary(spark, rows("choice", [(0, 0), (0, 0)], usage=[(12, None), None]))
    assert (s["input_tokens"], s["total_tokens"], s["mean_tokens_per_item"]) == (12, 12, 6.0)
    assert summary(spark, rows("choice", [(0, 0)]))["input_tokens"] is None


def test_elapsed(spark):
    df = spark.createDataFrame(rows("choice", [(0, 0), (0, 1)], latency=[1000, 1000]), SCHEMA)
    assert M.summarize(df).first()["throughput_items_per_second"] == 1.0
    elapsed = spark.createDataFrame([("m", "d", "choice", 0.5)], "model string, dataset string, task string, elapsed_seconds double")
    assert M.summarize(df, elapsed=elapsed).first()["throughput_items_per_second"] == 4.0
    zero = elapsed.withColumn("elapsed_seconds", F.lit(0.0))
    assert M.summarize(df, elapsed=zero).first()["throughput_items_per_second"] == 0.0


def brute(pairs, probabilities):
    """Definitions spelled out with plain loops."""
    n = len(pairs)
    hits = [p == g for p, g in pairs]
    nll = -sum(math.log(max(pr[g], 1e-12)) for pr, (_, g) in zip(probabilities, pairs)) / n
    brier = sum(sum((v - (i == g)) ** 2 for i, v in enumerate(pr)) for pr, (_, g) in zip(probabilities, pairs)) / n
    bins = {}
    for pr, (_, g) in zip(probabilities, pairs):
        top = max(range(len(pr)), key=pr.__getitem__)
        bins.setdefault(min(int(pr[top] * 10), 9), []).append((pr[top], top == g))
    ece = sum(
        len(b) / n * abs(statistics.fmean(h for _, h in b) - statistics.fmean(c for c, _ in b)) for b in bins.values()
    )
    k = max(max(x) for x in pairs) + 1
    observed = sum((p - g) ** 2 for p, g in pairs) / n
    expected = sum(
        (p - g) ** 2 * sum(x == p for x, _ in pairs) * sum(y == g for _, y in pairs) for p in range(k) for g in range(k)
    ) / n**2

    def ranks(values):
        return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]

    rp, rg = ranks([p for p, _ in pairs]), ranks([g for _, g in pairs])
    sd = np.std(rp) * np.std(rg)
    return {
        "accuracy": sum(hits) / n, "nll": nll, "brier_score": brier, "ece": ece,
        "quadratic_weighted_kappa": 1 - observed / expected if expected else 1.0,
        "spearman": float(np.cov(rp, rg, bias=True)[0, 1] / sd) if sd else 0.0,
        "mae": statistics.fmean(abs(p - g) for p, g in pairs),
        "rmse": math.sqrt(statistics.fmean((p - g) ** 2 for p, g in pairs)),
    }


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n, k = rng.randint(5, 120), rng.randint(2, 6)
    probabilities = []
    for _ in range(n):
        w = [rng.random() ** 3 + 1e-9 for _ in range(k)]
        probabilities.append([v / sum(w) for v in w])
    pairs = [(max(range(k), key=p.__getitem__), rng.randrange(k)) for p in probabilities]
    s = summary(spark, rows("score", pairs, probabilities))
    for name, value in brute(pairs, probabilities).items():
        assert s[name] == pytest.approx(value, abs=1e-10), name


def test_merged_cells_equal_one_pass(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(4), rng.randrange(4)) for _ in range(200)]
    df = spark.createDataFrame(rows("score", pairs), SCHEMA)
    halves = [df.filter(F.col("id") < "5"), df.filter(F.col("id") >= "5")]
    merged = M.merge_cells(M.metric_cells(halves[0]).unionByName(M.metric_cells(halves[1])))
    assert M.finalize(merged).first() == M.finalize(M.metric_cells(df)).first()


@pytest.mark.parametrize("kind", ["uniform", "outlier", "ties", "tiny", "negative", "single"])
def test_percentiles_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "uniform": rng.uniform(0, 100, 501),
        "outlier": np.concatenate([rng.uniform(5, 5.001, 300), [1e12]]),
        "ties": rng.integers(0, 3, 400).astype(float),
        "tiny": rng.uniform(0, 1e-9, 100),
        "negative": rng.normal(0, 50, 333),
        "single": np.array([4.25]),
    }[kind]
    df = spark.createDataFrame([("m", float(v)) for v in values], "k string, latency_ms double")
    fractions = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = P.percentiles(P.value_cells(df, ["k"]), ["k"], fractions).first()
    for name, f in fractions.items():
        assert got[name] == pytest.approx(np.quantile(values, f), rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("kind", ["band", "nested", "extremes", "integers"])
def test_percentiles_in_narrow_bands(spark, kind):
    """All values within a relative width of 1e-6 and less, nested bands, and the ends of the type."""
    rng = np.random.default_rng(4)
    values = {
        "band": 5 + rng.uniform(0, 1e-6, 3000),
        "nested": np.concatenate([7 + rng.uniform(0, 10.0**-k, 300) for k in (0, 4, 8, 12, 15)]),
        "extremes": np.array([-1.7e308, -5e-324, -0.0, 0.0, 5e-324, 1e-310, 1.0, 1.7e308, -1.0]),
        "integers": rng.integers(-(10**12), 10**12, 500),
    }[kind]
    kind_of = "bigint" if kind == "integers" else "double"
    df = spark.createDataFrame([("m", v.item()) for v in values] + [(None, values[0].item())], f"k string, latency_ms {kind_of}")
    fractions = {"p0": 0.0, "p1": 0.125, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in P.percentiles(P.value_cells(df, ["k"]), ["k"], fractions).collect()}
    values = np.sort(values.astype(float))
    for name, f in fractions.items():
        at = (len(values) - 1) * f
        lo, hi, weight = values[int(np.floor(at))], values[int(np.ceil(at))], at - np.floor(at)
        assert got["m"][name] == lo * (1 - weight) + hi * weight
        assert got[None][name] == (df.filter("k IS NULL").first()["latency_ms"])


def test_no_task_orders_a_whole_band(spark):
    """200,000 different latencies of one group in one band: what is left to be ordered is a few values."""
    df = spark.range(200_000).selectExpr("'m' AS k", "5 + id * 1e-12 AS latency_ms")
    rows = P.with_ordered_bits(P.value_cells(df, ["k"]).select(F.struct("k").alias("__group"), "value", "n"))
    assert rows.selectExpr("max(bits >> 48) - min(bits >> 48)").first()[0] == 0
    assert rows.count() > 150_000
    fractions = {"p50": 0.5, "p95": 0.95}
    ranges = P.wanted_ranges(rows, fractions, 2).cache()
    assert ranges.count() <= 4
    sizes = P.in_ranges(rows, ranges, 2).groupBy("__group", "prefix").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1 << 16


def test_ordered_bits_order_like_values(spark):
    values = [float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 1e-3, 1.0, 1.0000000000000002, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    bits = [r["bits"] for r in P.with_ordered_bits(df).orderBy("value").collect()]
    assert bits == sorted(set(bits)) and len(bits) == len(values)


def test_percentile_of_four(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4)], "k string, latency_ms double")
    assert P.percentiles(P.value_cells(df, ["k"]), ["k"], {"p": 0.5}).first()["p"] == 2.5


def test_empty_groups(spark):
    df = spark.createDataFrame(rows("score", [(0, 0)]), SCHEMA)
    groups = spark.createDataFrame(
        [("m", "d", "score"), ("m", "e", "score"), ("m", "f", "noul")], "model string, dataset string, task string"
    )
    got = {r["dataset"]: r for r in M.with_empty_groups(groups, M.summarize(df), M.KEYS).collect()}
    assert got["d"]["total"] == 1
    assert [got["e"][c] for c in M.ORDINAL_DEFAULTS] == [0, 0, 0, 0, 0.5]
    assert got["f"]["f1"] == 0.0 and got["f"]["mae"] is None and got["f"]["accuracy"] == 0.0


def test_confusion(spark):
    df = spark.createDataFrame(rows("score", [(0, 0), (1, 0), (1, 1), (1, 1)]), SCHEMA)
    got = {(r["gold_index"], r["predicted_index"]): (r["n"], r["gold_total"], r["predicted_total"])
           for r in M.confusion(df).collect()}
    assert got == {(0, 0): (1, 2, 1), (0, 1): (1, 2, 3), (1, 1): (2, 2, 3)}
    wide = {r["gold_index"]: (r["p0"], r["p1"]) for r in M.confusion_wide(df, 2).collect()}
    assert wide == {0: (1, 1), 1: (0, 2)}


def test_approximate_latency(spark):
    df = spark.createDataFrame(rows("choice", [(0, 0)] * 100, latency=list(range(100))), SCHEMA)
    got = M.approximate_latency(df).first()
    assert abs(got["p50_latency_ms"] - 49.5) <= 1 and abs(got["p95_latency_ms"] - 94.05) <= 1.1
