"""The evaluation workflow: configuration -> items -> predictions -> leaderboard."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators.items import build_items
from gavel.operators.leaderboard import dataset_scores, leaderboard, task_scores
from gavel.operators.metrics import summarize
from gavel.schemas import ITEM_TEXTS, SCHEMA_VERSION, TASKS, require_rows, validate_predictions
from gavel.session import checked_broadcast, local_table, materialize
from gavel.sources import sinks
from gavel.sources.readers import glob, read_source, resolve_one

CONFIGURED = (
    "model STRING, task STRING, dataset STRING, metric STRING, max_error DOUBLE, feature STRING"
)
DEFAULT_METRIC = "accuracy"
SMOKE_LIMIT = 5  # fixed value: rows per dataset of a smoke run


class ConfigError(RuntimeError):
    """The evaluation configuration is not usable."""


def load_config(path: str) -> dict[str, Any]:
    """Configuration from JSON, or from YAML where PyYAML is installed."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as exc:
            raise ConfigError("YAML configurations need PyYAML; use JSON instead") from exc
        config = yaml.safe_load(text)
    else:
        config = json.loads(text)
    check_version(config)
    return config


@dataclass
class Evaluation:
    """Everything one run produces; all frames are lazy."""

    items: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    scores: DataFrame
    tasks: DataFrame
    board: DataFrame
    skipped: list[dict[str, str]]
    weights: Mapping[str, float]
    config: Mapping[str, Any]
    datasets: list[dict]
    models: list[str]
    elapsed_seconds: float


def check_version(config: Mapping[str, Any]) -> None:
    if config.get("version") != 1:
        raise ConfigError(f"unsupported config version: {config.get('version')!r}")


def _selected(entries: list[dict], chosen: list[str] | None, what: str) -> list[dict]:
    enabled = [e for e in entries if e.get("enabled", True)]
    if chosen is None:
        return enabled
    unknown = sorted(set(chosen) - {e["id"] for e in enabled})
    if unknown:
        raise ConfigError(f"selected {what} not found: {', '.join(unknown)}")
    return [e for e in enabled if e["id"] in chosen]


def plan_datasets(
    spark: SparkSession, config: Mapping[str, Any], phase: str = "production"
) -> tuple[list[dict], list[dict[str, str]]]:
    """Datasets to read, with task, limit and resolved path, and the skipped ones."""
    if phase not in ("smoke", "production"):
        raise ConfigError("phase must be smoke or production")
    check_version(config)
    root = str(config["runtime"]["datasets_root"]).rstrip("/")
    plans, skipped = [], []
    for task in TASKS:
        body = config.get("tasks", {}).get(task, {})
        if not body.get("enabled", True):
            continue
        listed = [str(d) for d in body.get("datasets", [])]
        for dataset in _selected(config["datasets"], listed or None, "datasets"):
            if dataset.get("task", "choice") != task:
                continue
            limit = dataset.get("limit")
            if phase == "smoke":
                smoke = int(body.get("smoke_limit", SMOKE_LIMIT))
                limit = smoke if limit is None else min(int(limit), smoke)
            pattern = f"{root}/{dataset['source']['path']}"
            if not glob(spark, pattern):
                skipped.append({"dataset": dataset["id"], "reason": "source_not_found"})
                continue
            plans.append(
                {**dataset, "task": task, "limit": limit, "path": resolve_one(spark, pattern)}
            )
    if not plans:
        raise ConfigError("no configured datasets are available")
    return plans, skipped


def load_items(spark: SparkSession, datasets: list[dict], seed: int = 42) -> DataFrame:
    """All datasets as one item table."""

    def load(dataset: dict) -> DataFrame:
        source = dataset["source"]
        rows = read_source(spark, source["format"], dataset["path"])
        items = build_items(rows, dataset["id"], source, seed, dataset.get("limit"))
        return items.withColumn("task", F.lit(dataset["task"]))

    return reduce(DataFrame.unionByName, [load(d) for d in datasets])


def task_models(config: Mapping[str, Any], task: str, models: list[str]) -> list[str]:
    """Those of `models` that a task is meant for: its `model_ids`, or all."""
    chosen = config.get("tasks", {}).get(task, {}).get("model_ids")
    return models if chosen is None else [m for m in models if m in chosen]


def configured_scores(spark: SparkSession, config: Mapping[str, Any], models: list[str]) -> DataFrame:
    """(model, task, dataset) rows the leaderboard expects."""
    by_id = {d["id"]: d for d in config["datasets"]}
    rows = []
    for task in TASKS:
        body = config.get("tasks", {}).get(task, {})
        metric = body.get("aggregate_metric", DEFAULT_METRIC)
        for dataset in body.get("datasets", []):
            extra = by_id[dataset]
            for model in task_models(config, task, models):
                rows.append(
                    (model, task, dataset, metric, _maybe_float(extra.get("max_error")),
                     extra.get("feature"))
                )
    return local_table(spark, rows, CONFIGURED)


def _maybe_float(value: Any) -> float | None:
    return None if value is None else float(value)


def _pending(items: DataFrame, done: DataFrame | None, model: str) -> DataFrame:
    """Items of the datasets a model has no result for."""
    if done is None:
        return items
    finished = done.filter(F.col("model") == model).select("dataset")
    return items.join(checked_broadcast(finished), "dataset", "left_anti")


def evaluate(
    spark: SparkSession,
    config: Mapping[str, Any],
    scorers: Mapping[str, Callable[[DataFrame], DataFrame]],
    phase: str = "production",
    done: DataFrame | None = None,
) -> Evaluation:
    """Run every enabled model over every available dataset.

    `scorers` maps a model id to items -> scored items (scores, probabilities,
    predicted_index, latency_ms, score_metadata). `done` resumes a run: the
    metrics of finished (model, dataset) pairs are kept and not scored again.
    Items are converted once and every item is scored once: both tables are
    written to the shared folder. Question and options stay with the items, so that
    long texts are not written again for every model; `text_key`, their hash, tells
    items of one id apart. The board lists all enabled models.
    """
    datasets, skipped = plan_datasets(spark, config, phase)
    chosen = config["runtime"].get("selected_model_ids")
    enabled = [m["id"] for m in _selected(config["models"], None, "models")]
    models = [m["id"] for m in _selected(config["models"], chosen, "models")]
    items = load_items(spark, datasets, int(config["runtime"].get("seed", 42)))
    items = materialize(items.withColumn("text_key", F.xxhash64(*ITEM_TEXTS)), "items")
    for dataset in datasets:
        require_rows(items.filter(F.col("dataset") == dataset["id"]), dataset["id"])

    def scored(model: str) -> DataFrame:
        meant = [t for t in TASKS if model in task_models(config, t, models)]
        pending = _pending(items.filter(F.col("task").isin(meant)), done, model)
        return validate_predictions(scorers[model](pending)).drop(*ITEM_TEXTS).withColumn("model", F.lit(model))

    started = time.monotonic()
    predictions = materialize(reduce(DataFrame.unionByName, map(scored, models)), "predictions")
    elapsed = time.monotonic() - started
    metrics = summarize(predictions)
    if done is not None:
        metrics = done.select(metrics.columns).unionByName(metrics)
    scores = dataset_scores(configured_scores(spark, config, enabled), metrics)
    tasks = task_scores(scores)
    weights = config.get("tasks", {}).get("summary", {}).get("weights", {})
    return Evaluation(
        items, predictions, metrics, scores, tasks, leaderboard(tasks, weights), skipped, weights,
        config, datasets, models, elapsed,
    )


def run_metadata(
    spark: SparkSession, run_id: str, datasets: list[dict], models: list[dict], batch_size: int = 1
) -> DataFrame:
    """One row per (model, dataset) of a run: what ran, on which revision, with which scorer."""
    created = datetime.now(UTC).isoformat()
    rows = [
        (
            SCHEMA_VERSION, f"{run_id}/{m['id']}/{d['id']}", created, d["id"], d["task"],
            d["source"].get("revision"), batch_size, m.get("scorer", "unknown"), m["id"],
        )
        for m in models
        for d in datasets
    ]
    return local_table(
        spark,
        rows,
        "schema_version INT, run_id STRING, created_at STRING, dataset STRING, task_type STRING, "
        "dataset_revision STRING, batch_size INT, scorer STRING, model STRING",
    )


def saved_metadata(run: Evaluation, run_id: str) -> DataFrame:
    """Metadata of every (model, dataset) a run is meant for, in the shape of a run directory."""
    listed = {m["id"]: m for m in run.config["models"]}
    rows = [
        run_metadata(
            run.items.sparkSession, run_id, [d],
            [listed[m] for m in task_models(run.config, d["task"], run.models)],
            int(run.config["runtime"].get("batch_size", 1)),
        )
        for d in run.datasets
    ]
    return reduce(DataFrame.unionByName, rows).select(
        "schema_version", "run_id", "created_at", "dataset", "task_type", "dataset_revision",
        F.lit(int(run.config["runtime"].get("seed", 42))).alias("seed"), "batch_size",
        F.struct("scorer", "model").alias("scorer"),
    )


def run_ledger(run: Evaluation, run_id: str, metrics: DataFrame) -> DataFrame:
    """The run's status row: what was read, skipped with its reason, left out, scored and how long it took.

    `elapsed_seconds` is the wall time of the pass that scored the items. The
    configuration is kept as text, so that a ledger of many runs has one schema.
    """
    spark = run.items.sparkSession
    skipped = local_table(
        spark, [(run_id, s["dataset"], s["reason"]) for s in run.skipped], "run STRING, dataset STRING, reason STRING"
    )
    disabled = sorted({m["id"] for m in run.config["models"]} - set(run.models))
    config = json.dumps(run.config, ensure_ascii=False, sort_keys=True, default=str)
    row = (run_id, bool(run.models), len(run.datasets), run.models, disabled, run.elapsed_seconds, config)
    runs = local_table(
        spark, [row],
        "run STRING, enabled BOOLEAN, datasets INT, models ARRAY<STRING>, disabled_models ARRAY<STRING>, "
        "elapsed_seconds DOUBLE, config STRING",
    )
    counts = metrics.agg(F.lit(run_id).alias("run"), F.coalesce(F.sum("total"), F.lit(0)).alias("predictions"))
    return sinks.run_status(runs.join(counts, "run", "left"), skipped)


def save(run: Evaluation, root: str, run_id: str, phase: str = "production") -> None:
    """Store a run: predictions and items once, then metadata, metrics, leaderboard and status from the stored rows.

    `read_saved` reads predictions and metadata back as records. The items hold the
    questions and options of all models' predictions, by dataset, id and text_key.
    """
    spark = run.items.sparkSession
    predictions = run.predictions.withColumn("run", F.lit(run_id))
    sinks.write_predictions(predictions, f"{root}/predictions")
    sinks.write_items(run.items.withColumn("run", F.lit(run_id)), f"{root}/items")
    sinks.write_run_metadata(saved_metadata(run, run_id), f"{root}/metadata")
    stored = spark.read.schema(predictions.schema).parquet(f"{root}/predictions")
    metrics = summarize(stored)
    sinks.write_summaries(metrics, f"{root}/metrics")
    board_metrics = spark.read.schema(metrics.schema).json(f"{root}/metrics")
    expected = run.scores.select("model", "task", "dataset", "metric", "max_error")
    scores = dataset_scores(expected, board_metrics)
    tasks = task_scores(scores)
    documents = sinks.leaderboard_json(leaderboard(tasks, run.weights, order=False), tasks, scores, phase)
    sinks.write_leaderboard(documents, f"{root}/leaderboard")
    sinks.append_status(run_ledger(run, run_id, board_metrics), f"{root}/status")
