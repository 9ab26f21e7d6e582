import pytest
from pyspark.sql import functions as F

from gavel.operators import catalog as C
from gavel.operators import filters as W
from gavel.operators import leaderboard as L
from gavel.operators import matrices as X

CONFIGURED = "model string, task string, dataset string, metric string, max_error double"
METRICS = (
    "model string, dataset string, task string, accuracy double, f1 double, mae double, spearman double, "
    "total bigint, mean_latency_ms double"
)


def scored(spark, configured, metrics):
    return L.dataset_scores(spark.createDataFrame(configured, CONFIGURED), spark.createDataFrame(metrics, METRICS))


def row(model, dataset, accuracy=None, f1=None, mae=None, spearman=None, total=1, latency=1.0):
    return (model, dataset, None, accuracy, f1, mae, spearman, total, latency)


def test_two_of_three(spark):
    configured = [("m", "choice", "a", "accuracy", None), ("m", "choice", "b", "accuracy", None),
                  ("m", "noul", "n", "f1", None)]
    metrics = [row("m", "a", 0.8), row("m", "b", 0.6), row("m", "n", f1=0.5)]
    board = L.leaderboard(L.task_scores(scored(spark, configured, metrics))).first()
    assert board["choice"] == pytest.approx(0.7) and board["noul"] == 0.5 and board["score"] is None
    assert board["score_status"] == "unavailable" and board["overall"] == pytest.approx(0.6)
    assert (board["overall_status"], board["coverage"]) == ("partial", "2/3")


def test_three_of_three_yet_partial(spark):
    configured = [("m", "noul", "n1", "f1", None), ("m", "noul", "n2", "f1", None),
                  ("m", "choice", "c", "accuracy", None), ("m", "score", "s", "spearman", None)]
    metrics = [row("m", "n1", f1=0.5), row("m", "c", 0.7), row("m", "s", spearman=0.0)]
    board = L.leaderboard(L.task_scores(scored(spark, configured, metrics))).first()
    assert (board["overall_status"], board["coverage"], board["noul_status"]) == ("partial", "3/3", "partial")
    assert board["score"] == 0.5


def test_weights_and_empty_models(spark):
    configured = [("m", "noul", "n", "f1", None), ("m", "choice", "c", "accuracy", None), ("x", "noul", "n", "f1", None)]
    scores = scored(spark, configured, [row("m", "n", f1=0.2), row("m", "c", 0.8)])
    tasks = L.task_scores(scores)
    got = L.leaderboard(tasks, {"noul": 3, "choice": 1}).collect()
    assert [r["model"] for r in got] == ["m"] and got[0]["overall"] == pytest.approx(0.35)
    got = L.leaderboard(tasks, {"noul": 0}).first()
    assert got["overall"] == pytest.approx(0.8) and got["coverage"] == "1/3"


@pytest.mark.parametrize(
    "metric,values,max_error,message",
    [("accuracy", {"accuracy": 70.0}, None, "0-1 range"), ("mae", {"mae": 1.0}, None, "max_error"),
     ("f1", {"accuracy": 0.5}, None, "metric missing")],
)
def test_bad_metrics_fail(spark, metric, values, max_error, message):
    scores = scored(spark, [("m", "score", "d", metric, max_error)], [row("m", "d", **values)])
    with pytest.raises(Exception, match=message):
        scores.collect()


def test_error_metrics(spark):
    scores = scored(spark, [("m", "score", "d", "mae", 4.0), ("m", "score", "e", "mae", 1.0)],
                    [row("m", "d", mae=1.0), row("m", "e", mae=3.0)])
    assert {r["dataset"]: r["normalized"] for r in scores.collect()} == {"d": 0.75, "e": 0.0}


def test_merge_supplement_patch_pending_common(spark):
    a = spark.createDataFrame([("m", 0.1), ("n", 0.2)], "model string, overall double")
    b = spark.createDataFrame([("n", 0.9), ("o", 0.3)], "model string, overall double")
    assert sorted(map(tuple, L.merge_runs([a, b]).collect())) == [("m", 0.1), ("n", 0.2), ("o", 0.3)]
    pairs = "model string, dataset string, value double, normalized double"
    one = spark.createDataFrame([("m", "a", 1.0, 1.0)], pairs)
    two = spark.createDataFrame([("m", "a", 0.0, 0.0), ("m", "b", 0.5, 0.5)], pairs)
    both = L.supplement(one, two)
    assert sorted(r["value"] for r in both.collect()) == [0.5, 1.0]
    patch = spark.createDataFrame([("m", "b", 0.25)], "model string, dataset string, value double")
    assert sorted(r["normalized"] for r in L.patch(both, patch).collect()) == [0.25, 1.0]
    assert [tuple(r) for r in L.pending_pairs(two.select("model", "dataset"), one).collect()] == [("m", "b")]
    more = two.unionByName(spark.createDataFrame([("n", "a", 0.0, 0.0)], pairs))
    assert [r[0] for r in L.common_datasets(more, more.select("model")).collect()] == ["a"]


def test_relabel(spark):
    preds = spark.createDataFrame([("d", "1", 0, 1), ("d", "2", 1, 1)], "dataset string, id string, gold_index int, predicted_index int")
    gold = spark.createDataFrame([("d", "1", 1), ("d", "2", 1)], "dataset string, id string, gold_index int")
    got = {r["id"]: (r["gold_index"], r["predicted_index"], r["flipped"]) for r in L.relabel(preds, gold).collect()}
    assert got == {"1": (1, 1, True), "2": (1, 1, False)}
    with pytest.raises(Exception, match="no corrected gold"):
        L.relabel(preds, gold.filter("id = '1'")).collect()


def test_orders(spark):
    rows = [("B", None, "x", "l"), ("A", 7.0, "x", "l"), ("A", 0.0, "x", "l"), ("A", 7.0, "a", "l")]
    df = spark.createDataFrame(rows, "family string, size double, variant string, label string")
    assert [(r[0], r[1], r[2]) for r in L.catalog_order(df).collect()] == [
        ("A", 7.0, "a"), ("A", 7.0, "x"), ("A", 0.0, "x"), ("B", None, "x")
    ]
    speed = spark.createDataFrame([("a", 2.0, 0.1), ("b", 1.0, 0.9)], "model string, latency double, f1 double")
    assert [r["model"] for r in L.ranking_order(speed, "latency").collect()] == ["b", "a"]
    assert [r["model"] for r in L.ranking_order(speed, "f1").collect()] == ["b", "a"]


def test_matrices(spark):
    rows = [("m", "a", {"accuracy": 50.0}), ("m", "b", {"accuracy": 25.0})]
    df = spark.createDataFrame(rows, "model string, dataset string, metrics struct<accuracy: double>")
    got = X.series_matrix(df, "model", ["a", "b"], metric="metrics.accuracy", scale="percent").first()
    assert (got["a"], got["b"]) == (0.5, 0.25)
    with pytest.raises(Exception, match="duplicate axis"):
        X.series_matrix(df.union(df), "model", ["a", "b"], metric="metrics.accuracy", scale="percent").collect()
    with pytest.raises(Exception, match="lacks axes"):
        X.series_matrix(df, "model", ["a", "c"], metric="metrics.accuracy", scale="percent").collect()
    with pytest.raises(Exception, match="0-1 range"):
        X.series_matrix(df, "model", ["a", "b"], metric="metrics.accuracy").collect()
    point = X.single_point(df, {"model": "m", "dataset": "b"}, "metrics.accuracy", "percent")
    assert point.first()["value"] == 0.25
    with pytest.raises(Exception, match="exactly one row"):
        X.single_point(df, {"model": "m"}, "metrics.accuracy", "percent").collect()
    with pytest.raises(ValueError):
        X.fraction(F.lit(1), "score")
    with pytest.raises(ValueError):
        W.match_nested(df, {"model": "zz"}, required=True)


def test_selection_errors(spark):
    known = spark.createDataFrame([("a",)], "id string")
    chosen = spark.createDataFrame([("z",), ("a",), ("b",)], "id string")
    W.require_known(known, known, "id")
    with pytest.raises(ValueError, match="unknown id: b, z"):
        W.require_known(chosen, known, "id")


@pytest.mark.parametrize(
    "model,expected",
    [("Qwen3-4B-Instruct-2507", ("Qwen3", 4.0, "Instruct", ["Instruct"])),
     ("Qwen3.5-0.8B", ("Qwen3.5", 0.8, "Instruct + Thinking", ["Instruct", "Thinking"])),
     ("qwen3-swallow-8b-sft", ("Qwen3-Swallow", 8.0, "SFT", ["other"])),
     ("gemma-4-E2B-it-qat", ("Gemma 4", 2.0, "Instruct · QAT", ["Instruct"])),
     ("Qwen3-4B-Base", ("Qwen3", 4.0, "Base", ["Base"])),
     ("llm-jp-4-8b-thinking", ("LLM-jp 4", 8.0, "Thinking", ["Thinking"])),
     ("service-latest", ("Other", None, "Base", ["Base"]))],
)
def test_model_spec(one, model, expected):
    spec = C.model_spec(F.lit(model))
    assert tuple(one(spec["family"], spec["size"], spec["variant"], spec["tags"])) == expected


def test_ranking_filter(spark):
    rows = [("a", 4.0, ["Instruct"], 0.5), ("b", None, ["other"], 0.4), ("c", 40.0, ["Instruct"], 0.3), ("d", 4.0, ["Base"], 0.2),
            ("e", 4.0, ["Instruct"], None)]
    df = spark.createDataFrame(rows, "model string, size double, tags array<string>, overall double")

    def kept(**options):
        return [r["model"] for r in W.ranking_filter(df, "overall", ["Instruct", "other"], 1, 8, **options).collect()]

    assert kept() == ["a", "b"] and kept(include_unsized=False) == ["a"]
