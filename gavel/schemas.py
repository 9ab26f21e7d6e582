"""Row shapes of the evaluation tables and their constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
TASKS = ("noul", "choice", "score")
LABELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_OPTIONS = len(LABELS)

ITEM = (
    "dataset STRING, task STRING, id STRING, question STRING, options ARRAY<STRING>, "
    "gold_index INT, metadata MAP<STRING,STRING>"
)
ITEM_COLUMNS = ("dataset", "task", "id", "question", "options", "gold_index", "metadata")
ITEM_TEXTS = ("question", "options")  # what a prediction does not repeat

USAGE = "STRUCT<input_tokens: BIGINT, output_tokens: BIGINT>"
SCORE_METADATA = f"STRUCT<usage: {USAGE}>"
PREDICTION = (
    "model STRING, dataset STRING, task STRING, id STRING, gold_index INT, predicted_index INT, "
    "scores ARRAY<DOUBLE>, probabilities ARRAY<DOUBLE>, latency_ms DOUBLE, "
    f"item_metadata MAP<STRING,STRING>, score_metadata {SCORE_METADATA}"
)

# One prediction line in a run directory (the run's own fields live in its metadata file).
PREDICTION_LINE = (
    "id STRING, gold_index INT, predicted_index INT, scores ARRAY<DOUBLE>, "
    "probabilities ARRAY<DOUBLE>, latency_ms DOUBLE, item_metadata MAP<STRING,STRING>, "
    f"score_metadata {SCORE_METADATA}"
)
RUN_METADATA = (
    "schema_version INT, run_id STRING, created_at STRING, dataset STRING, task_type STRING, "
    "dataset_revision STRING, seed INT, batch_size INT, git_commit STRING, "
    "scorer STRUCT<scorer: STRING, model: STRING>, environment MAP<STRING,STRING>"
)

CATALOG_ENTRY = (
    "id STRING, title STRING, description STRING, reason STRING, tasks ARRAY<STRING>, "
    "source STRUCT<kind: STRING, repo_id: STRING, url: STRING, path: STRING, config: STRING, "
    "split: STRING, revision: STRING, derived_from: STRUCT<repo_id: STRING>>, "
    "url STRING, license STRING, rows BIGINT, access STRING, distribution STRING, "
    "profile_datasets ARRAY<STRING>"
)
MANIFEST = (
    "version INT, repo_id STRING, license STRING, subsets MAP<STRING,ARRAY<STRING>>, "
    f"datasets ARRAY<STRUCT<{CATALOG_ENTRY}>>, excluded ARRAY<STRUCT<{CATALOG_ENTRY}>>"
)

# One shape for the rubric corpus: question with described options and an expected label.
RUBRIC_ROW = (
    "id STRING, lang STRING, question_type STRING, state STRING, instructions STRING, "
    "options ARRAY<STRUCT<label: STRING, description: STRING>>, expected STRING, "
    "family STRING, topic STRING, source STRING, difficulty STRING"
)
CRITERIA = "ARRAY<STRUCT<id: STRING, index: INT, label: STRING>>"


def require(df: DataFrame, condition: Column, message: str | Column) -> DataFrame:
    """Fail the job on any row that breaks `condition` (NULL counts as broken).

    Written as a filter so that column pruning cannot drop the check.
    """
    text = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.when(condition, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


Check = tuple[str, Column, str]  # guarded column, condition, message


def item_checks(max_options: int | None = None, max_chars: int | None = None) -> list[Check]:
    from gavel.functions.text import strip

    gold_ok = (F.col("gold_index") >= 0) & (F.col("gold_index") < F.size("options"))
    checks = [
        ("question", F.length(strip(F.col("question"))) > 0, "question must not be empty"),
        ("options", F.size("options") >= 2, "at least two options are required"),
        ("gold_index", gold_ok, "gold_index is outside options"),
    ]
    if max_options is not None:
        checks.append(("options", F.size("options") <= max_options, "too many options"))
    if max_chars is not None:
        ok = F.length("question") <= max_chars
        checks.append(("question", ok, "input is longer than the limit"))
    return checks


def prediction_checks() -> list[Check]:
    predicted_ok = (F.col("predicted_index") >= 0) & (
        F.col("predicted_index") < F.size("scores")
    )
    same_length = F.col("probabilities").isNull() | (
        F.size("probabilities") == F.size("scores")
    )
    return [
        ("scores", F.size("scores") > 0, "scores must not be empty"),
        ("predicted_index", predicted_ok, "predicted_index is outside scores"),
        ("probabilities", same_length, "probabilities and scores must have equal length"),
    ]


def _checked(df: DataFrame, checks: list[Check], mode: str) -> DataFrame:
    """`fail`: a broken value raises when it is read. `quarantine`: adds `problem`. `strict`: a broken row raises always.

    In `fail` the checks ride on the columns they protect. As the filter that
    `strict` uses they are not pruned, so counts and projections of other columns
    fail too, but they may be pushed below the projection that builds the
    columns and build them twice.
    """
    broken = [(c, ~F.coalesce(ok, F.lit(False)), text) for c, ok, text in checks]
    problem = F.coalesce(*[F.when(bad, F.lit(t)) for _, bad, t in broken])
    if mode == "quarantine":
        return df.withColumn("problem", problem)
    if mode == "strict":
        return require(df, problem.isNull(), problem)
    if mode != "fail":
        raise ValueError(f"unknown mode: {mode}")
    guarded: dict[str, Column] = {}
    for name, bad, text in broken:
        error = F.raise_error(F.lit(text)).cast(df.schema[name].dataType)
        guarded[name] = F.when(bad, error).otherwise(guarded.get(name, F.col(name)))
    return df.withColumns(guarded)


def validate_items(
    df: DataFrame,
    mode: str = "fail",
    max_options: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Item constraints: fail the job (`fail`, or `strict` for any read), or keep every row with a `problem` column.

    Only scorers that name options by letters bound their number (MAX_OPTIONS).
    """
    return _checked(df, item_checks(max_options, max_chars), mode)


def validate_predictions(df: DataFrame, mode: str = "fail") -> DataFrame:
    """Prediction constraints: fail the job (`fail`, or `strict` for any read), or keep every row with a `problem` column."""
    return _checked(df, prediction_checks(), mode)


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """An empty dataset is an error."""
    if df.isEmpty():
        raise ValueError(f"dataset is empty: {name}")
    return df
