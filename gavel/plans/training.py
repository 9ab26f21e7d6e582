"""The training workflow: corpus -> items -> vectors -> cross-validated heads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators.corpus import load_corpus
from gavel.operators.scoring import encode_once
from gavel.operators.training import Fitted, Trainer, cross_validate, get_trainer
from gavel.session import materialize
from gavel.sources.readers import read_rubric_corpus


@dataclass
class TrainingRun:
    """Models per fold and their summary; no summary when nothing was held out."""

    task: str
    models: list[Fitted]
    summary: DataFrame | None


def training_vectors(items: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Items with the vectors the heads read: `embedding` (yes/no) and `candidates`."""
    return encode_once(items, encode).withColumnsRenamed(
        {"state_vector": "embedding", "candidate_vectors": "candidates"}
    )


def run_training(
    spark: SparkSession,
    paths: Sequence[str],
    tasks: Sequence[str],
    encode: Callable[[DataFrame], DataFrame],
    lang: str | None = "Japanese",
    folds: int = 5,
    limit: int | None = None,
    seed: int = 42,
    trainers: dict[str, Callable[[], Trainer]] | None = None,
) -> dict[str, TrainingRun]:
    """Cross-validate one head per task.

    The vectors are written once to the shared folder: every fold and epoch
    reads them, and a lost executor does not encode them again.
    """
    corpus = read_rubric_corpus(spark, paths)
    runs = {}
    for task in tasks:
        default = "yes_no_head" if task == "noul" else "candidate_head"
        trainer = (trainers or {}).get(task, lambda name=default: get_trainer(name))
        items = load_corpus(corpus, task, "corpus", lang, limit)
        vectors = materialize(
            training_vectors(items, encode).select(
                "id", "task", "gold_index", F.col("embedding"), F.col("candidates")
            ),
            f"vectors-{task}",
        )
        models, summary = cross_validate(vectors, trainer, folds, seed=seed)
        runs[task] = TrainingRun(task, models, summary)
    return runs
