import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gavel.operators.scoring import mock_scores
from gavel.plans import evaluation as E
from gavel.plans.scoring_queries import hash_encoder
from gavel.plans.training import run_training
from gavel.sources.readers import read_saved

USAGE = "struct<usage: struct<input_tokens: bigint, output_tokens: bigint>>"


def config(root, **runtime):
    return {
        "version": 1,
        "runtime": {"datasets_root": str(root), **runtime},
        "models": [{"id": "a"}, {"id": "b"}, {"id": "off", "enabled": False}],
        "datasets": [
            {"id": "yes", "task": "noul", "limit": 8,
             "source": {"path": "yes.jsonl", "format": "jsonl", "adapter": "noul", "gold_field": "y", "positive_values": [1]}},
            {"id": "lvl", "task": "score", "max_error": 2,
             "source": {"path": "lvl.jsonl", "format": "jsonl", "adapter": "score", "criteria": ["l", "m", "h"]}},
            {"id": "gone", "task": "choice", "source": {"path": "gone.csv", "format": "csv"}},
        ],
        "tasks": {
            "noul": {"datasets": ["yes"], "aggregate_metric": "f1", "smoke_limit": 3},
            "score": {"datasets": ["lvl"], "aggregate_metric": "mae"},
            "choice": {"datasets": ["gone"]},
        },
    }


@pytest.fixture
def root(tmp_path):
    rows = [{"id": i, "text": f"t{i}", "y": i % 2, "state": f"s{i}", "gold_score": i % 3} for i in range(12)]
    for name in ("yes", "lvl"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    return tmp_path


def scorer(model):
    def run(items):
        return mock_scores(items, F.lit(model)).withColumns(
            {"latency_ms": F.lit(2.0), "score_metadata": F.lit(None).cast(USAGE)}
        )

    return run


SCORERS = {"a": scorer("a"), "b": scorer("b")}


def test_run_and_save(spark, root, tmp_path):
    run = E.evaluate(spark, config(root), SCORERS)
    assert run.skipped == [{"dataset": "gone", "reason": "source_not_found"}]
    totals = {(r["model"], r["dataset"]): r["total"] for r in run.metrics.collect()}
    assert totals == {("a", "yes"): 8, ("b", "yes"): 8, ("a", "lvl"): 12, ("b", "lvl"): 12}
    board = {r["model"]: r for r in run.board.collect()}
    assert set(board) == {"a", "b"} and board["a"]["coverage"] == "2/3" and board["a"]["choice"] is None
    out = f"{tmp_path}/out"
    E.save(run, out, "r1")
    documents = [json.loads(r["value"]) for r in spark.read.text(f"{out}/leaderboard").collect()]
    assert {d["id"]: d["overall_score"] for d in documents} == pytest.approx(
        {m: r["overall"] for m, r in board.items()}
    )
    status = spark.read.json(f"{out}/status").first()
    assert status["status"] == "partial" and status["reasons"] == [("gone", "source_not_found")]
    assert (status["predictions"], status["datasets"], status["models"], status["disabled_models"]) == (40, 2, ["a", "b"], ["off"])
    assert status["elapsed_seconds"] > 0 and json.loads(status["config"]) == config(root)
    back = read_saved(spark, out)
    assert {(r["run_id"], r["system_id"], r["n"]) for r in back.groupBy("run_id", "system_id").agg(F.count("sample_id").alias("n")).collect()} == {
        (f"r1/{m}/{d}", f"unknown:{m}", n) for m in "ab" for d, n in (("yes", 8), ("lvl", 12))
    }
    fields = ("dataset", "id", "model", "gold_index", "predicted_index", "scores", "latency_ms")
    stored = back.withColumnsRenamed({"dataset_id": "dataset", "sample_id": "id", "model_id": "model"})
    assert sorted(map(tuple, stored.select(*fields).collect())) == sorted(map(tuple, run.predictions.select(*fields).collect()))
    with pytest.raises(FileExistsError):
        E.save(run, out, "r1")


def test_saved_names_stay_text(spark, root, tmp_path):
    """A run and a model whose names look like numbers; a task meant for one model; a dataset nobody scores."""
    cfg = config(root)
    cfg["models"] = [{"id": "007", "scorer": "mock"}, {"id": "b"}]
    cfg["tasks"]["score"]["model_ids"] = ["007"]
    E.save(E.evaluate(spark, cfg, {"007": scorer("a"), "b": scorer("b")}), f"{tmp_path}/n", "01")
    rows = read_saved(spark, f"{tmp_path}/n").select("run_id", "method_id", "model_id", "primitive").distinct().collect()
    assert sorted(map(tuple, rows)) == [
        ("01/007/lvl", "mock", "007", "score"), ("01/007/yes", "mock", "007", "noul"), ("01/b/yes", "unknown", "b", "noul")
    ]


def test_long_texts_are_stored_once_a_run(spark, tmp_path):
    """Questions and options are no copy for every model: predictions grow with the rows, not with their texts."""

    def size(path):
        return sum(p.stat().st_size for p in Path(path.removeprefix("file:")).rglob("*.parquet"))

    rows = [{"id": i // 2, "text": random.Random(i).randbytes(10_000).hex(), "y": i % 2} for i in range(30)]
    (tmp_path / "yes.jsonl").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    cfg = config(tmp_path)
    cfg["datasets"] = [{**cfg["datasets"][0], "limit": None}]
    cfg["tasks"] = {"noul": {"datasets": ["yes"]}}
    run = E.evaluate(spark, cfg, SCORERS)
    out = f"{tmp_path}/out"
    E.save(run, out, "r1")
    texts = size(run.items._scratch_path)
    assert texts > 300_000  # incompressible
    assert size(run.predictions._scratch_path) < texts / 5 and size(f"{out}/predictions") < texts / 5
    assert read_saved(spark, out).count() == 60
    items = spark.read.parquet(f"{out}/items")
    assert items.select("run", "dataset").distinct().collect() == [("r1", "yes")]
    # Every prediction finds its own whole text, also where ids repeat.
    stored = spark.read.parquet(f"{out}/predictions").select("model", "dataset", "id", "text_key", "scores")
    back = stored.join(items, ["dataset", "id", "text_key"]).collect()
    got = sorted((r["model"], r["id"], r["question"], tuple(r["options"]), r["gold_index"]) for r in back)
    assert got == sorted((m, f"yes:{r['id']}", r["text"], ("いいえ", "はい"), r["y"]) for m in "ab" for r in rows)
    again = [(m, r["question"], r["scores"]) for m in "ab" for r in scorer(m)(items).collect()]
    assert sorted(again) == sorted((r["model"], r["question"], r["scores"]) for r in back)


def test_smoke_selection_and_gates(spark, root):
    run = E.evaluate(spark, config(root, selected_model_ids=["b"]), SCORERS, phase="smoke")
    assert {(r["model"], r["dataset"]): r["total"] for r in run.metrics.collect()} == {("b", "yes"): 3, ("b", "lvl"): 5}
    with pytest.raises(E.ConfigError, match="zz"):
        E.evaluate(spark, config(root, selected_model_ids=["zz"]), SCORERS)
    with pytest.raises(E.ConfigError, match="version"):
        E.evaluate(spark, {**config(root), "version": 2}, SCORERS)
    with pytest.raises(E.ConfigError, match="phase"):
        E.evaluate(spark, config(root), SCORERS, phase="x")
    with pytest.raises(E.ConfigError, match="no configured datasets"):
        E.evaluate(spark, config(f"{root}/nowhere"), SCORERS)


def test_resume_scores_only_what_is_pending(spark, root):
    full = E.evaluate(spark, config(root), SCORERS)
    done = full.metrics.filter((F.col("model") == "a") | (F.col("dataset") == "yes"))
    resumed = E.evaluate(spark, config(root), SCORERS, done=done)
    assert {(r[0], r[1]) for r in resumed.predictions.select("model", "dataset").distinct().collect()} == {("b", "lvl")}
    key = ("model", "dataset", "total", "accuracy")
    assert sorted(map(tuple, resumed.metrics.select(*key).collect())) == sorted(map(tuple, full.metrics.select(*key).collect()))


def test_config_file(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"version": 1}')
    assert E.load_config(str(path)) == {"version": 1}
    path.write_text('{"version": 3}')
    with pytest.raises(E.ConfigError):
        E.load_config(str(path))


def test_run_metadata(spark):
    rows = E.run_metadata(spark, "r", [{"id": "d", "task": "noul", "source": {}}], [{"id": "m", "scorer": "mock"}]).collect()
    assert [(r["run_id"], r["task_type"], r["scorer"]) for r in rows] == [("r/m/d", "noul", "mock")]


def test_training(spark, tmp_path):
    def row(i, kind):
        return {
            "id": f"{kind}{i}", "lang": "Japanese", "question_type": kind, "state": f"s{i % 4}", "instructions": "ask",
            "options": [{"label": "yes", "description": "y"}, {"label": "no", "description": "n"}],
            "expected": "yes" if i % 4 < 2 else "no",
        }

    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(json.dumps(row(i, k)) for k in ("noul", "choice") for i in range(24)))
    runs = run_training(spark, [str(path)], ["noul", "choice"], hash_encoder, folds=2)
    assert {r["metric"] for r in runs["noul"].summary.collect()} == {"accuracy", "precision", "recall", "f1"}
    assert [r["metric"] for r in runs["choice"].summary.collect()] == ["accuracy"]
    single = run_training(spark, [str(path)], ["noul"], hash_encoder, folds=1)["noul"]
    assert len(single.models) == 1 and single.summary is None
