"""Dataset metrics -> task scores -> leaderboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.operators.ranking import first_wins, score_rank
from gavel.schemas import TASKS, require

PAIR = ("model", "dataset")
METRICS = (
    "accuracy", "f1", "precision", "recall", "nll", "brier_score", "ece", "mae", "rmse",
    "spearman", "quadratic_weighted_kappa", "normalized_quadratic_weighted_kappa",
)


def metric_value(metric: Column, available: Sequence[str]) -> Column:
    """The value of the metric named by a column."""
    value = F.lit(None).cast("double")
    for name in METRICS:
        if name in available:
            value = F.when(metric == name, F.col(name)).otherwise(value)
    return value


def normalized(metric: Column, value: Column, max_error: Column, dataset: Column) -> Column:
    """Metric on a 0-1 scale; a value outside its scale fails loudly."""

    def fail(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(text + ": "), dataset)).cast("double")

    return (
        F.when(value.isNull(), fail("metric missing for dataset"))
        .when(
            metric.isin("spearman", "quadratic_weighted_kappa"),
            F.least(F.greatest((value + 1) / 2, F.lit(0.0)), F.lit(1.0)),
        )
        .when(
            metric.isin("mae", "rmse"),
            F.when(max_error > 0, F.greatest(F.lit(0.0), 1 - value / max_error)).otherwise(
                fail("max_error required for dataset")
            ),
        )
        .when(value.between(0.0, 1.0), value)
        .otherwise(fail("metric must be in the 0-1 range for dataset"))
    )


def dataset_scores(configured: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every configured (model, task, dataset) with value and normalised score if present.

    `configured` has model, task, dataset, metric, max_error; `metrics` is the
    wide metric table.
    """
    names = [c for c in METRICS if c in metrics.columns]
    joined = configured.join(
        metrics.select(*PAIR, "total", *names), list(PAIR), "left"
    )
    present = F.col("total").isNotNull()
    value = metric_value(F.col("metric"), names)
    with_value = joined.withColumn("value", F.when(present, value))
    score = normalized(F.col("metric"), F.col("value"), F.col("max_error"), F.col("dataset"))
    return with_value.withColumn("normalized", F.when(present, score)).drop(*names)


def task_scores(scores: DataFrame) -> DataFrame:
    """Macro mean per (model, task) with completion counts and status."""
    out = scores.groupBy("model", "task").agg(
        F.avg("normalized").alias("score"),
        F.count("normalized").alias("completed"),
        F.count(F.lit(1)).alias("configured"),
    )
    status = (
        F.when(F.col("completed") == 0, "unavailable")
        .when(F.col("completed") == F.col("configured"), "complete")
        .otherwise("partial")
    )
    return out.withColumn("status", status)


def leaderboard(
    tasks: DataFrame, weights: Mapping[str, float] | None = None, order: bool = True
) -> DataFrame:
    """One row per model: task scores, weighted overall, status and coverage.

    Unavailable tasks and weights <= 0 leave numerator and denominator; models
    with nothing available are dropped.
    """
    given = {t: float((weights or {}).get(t, 1.0)) for t in TASKS}

    def pick(task: str, column: str) -> Column:
        return F.max(F.when(F.col("task") == task, F.col(column)))

    wide = tasks.groupBy("model").agg(
        *[pick(t, "score").alias(t) for t in TASKS],
        *[
            F.coalesce(pick(t, "status"), F.lit("unavailable")).alias(f"{t}_status")
            for t in TASKS
        ],
    )
    used = [t for t in TASKS if given[t] > 0]
    present = [F.col(t).isNotNull() for t in used]
    weight = sum((F.when(c, given[t]).otherwise(0.0) for t, c in zip(used, present)), F.lit(0.0))
    mass = sum(
        (F.coalesce(F.col(t) * given[t], F.lit(0.0)) for t in used), F.lit(0.0)
    )
    count = sum((c.cast("int") for c in present), F.lit(0))
    complete = F.lit(len(used) == len(TASKS))
    for t in TASKS:
        complete = complete & (F.col(f"{t}_status") == "complete")
    board = (
        wide.withColumn("available", count)
        .filter(F.col("available") > 0)
        .withColumn("overall", mass / weight)
        .withColumn("overall_status", F.when(complete, "complete").otherwise("partial"))
        .withColumn("coverage", F.concat(F.col("available").cast("string"), F.lit(f"/{len(TASKS)}")))
    )
    return order_board(board) if order else board


def order_board(board: DataFrame) -> DataFrame:
    """Best overall first, NULL as zero."""
    return board.orderBy(F.coalesce(F.col("overall"), F.lit(0.0)).desc(), "model")


def ranked(board: DataFrame) -> DataFrame:
    """Leaderboard with its rank number."""
    return score_rank(board, "overall", "model")


def catalog_order(models: DataFrame) -> DataFrame:
    """Family, size (unsized last), variant, label."""
    size = F.when(F.coalesce("size", F.lit(0.0)) == 0, 999.0).otherwise(F.col("size"))
    return models.orderBy("family", size, "variant", "label")


def ranking_order(models: DataFrame, metric: str) -> DataFrame:
    """Latency ascending, any other metric descending."""
    key = F.col(metric)
    return models.orderBy(key.asc() if metric == "latency" else key.desc(), "model")


def item_weighted_latency(
    metrics: DataFrame, keys: Sequence[str] = ("model",), rows: str = "total"
) -> DataFrame:
    """Mean latency over items (not a mean of means) and the item count."""
    return metrics.groupBy(*keys).agg(
        ratio_or_null(F.sum(F.col("mean_latency_ms") * F.col(rows)), F.sum(rows)).alias(
            "mean_latency_ms"
        ),
        F.sum(rows).alias("items"),
    )


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def strict_overall(tasks: DataFrame) -> DataFrame:
    """Overall only with every task complete, and the mean of the complete ones as fallback."""
    done = F.col("status") == "complete"
    out = tasks.groupBy("model").agg(
        F.count_if(done).alias("coverage"),
        F.avg(F.when(done, F.col("score"))).alias("provisional"),
    )
    complete = F.col("coverage") == len(TASKS)
    return out.withColumns(
        {
            "overall": F.when(complete, F.col("provisional")),
            "is_provisional": ~complete,
        }
    )


def single_task_board(metrics: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Rows for models with one evaluated task: coverage 1 and no overall."""
    scored = metrics.groupBy("model").agg(
        F.avg(metric).alias("score"),
        ratio_or_null(F.sum(F.col("mean_latency_ms") * F.col("total")), F.sum("total")).alias(
            "mean_latency_ms"
        ),
        F.sum("total").alias("items"),
    )
    return scored.withColumns({"coverage": F.lit(1), "overall": F.lit(None).cast("double")})


def headline(
    models: DataFrame, selected: Sequence[str] = (), service_family: str | None = None
) -> DataFrame:
    """Model count, best overall, best among the selected, fastest local model.

    `models` has label, model, family, overall and latency.
    """
    scored = F.col("overall").isNotNull()
    chosen = scored & F.col("model").isin(list(selected))
    local = F.col("latency") > 0
    if service_family is not None:
        local = local & (F.col("family") != service_family)

    def best(value: Column) -> Column:
        return F.max_by("label", F.struct(value, F.col("label")))

    return models.agg(
        F.count(F.lit(1)).alias("models"),
        best(F.when(scored, F.col("overall"))).alias("best"),
        F.max("overall").alias("best_overall"),
        F.max_by(
            F.when(chosen, F.col("label")), F.struct(F.when(chosen, F.col("overall")), F.col("label"))
        ).alias("best_selected"),
        F.min_by(
            F.col("label"),
            F.struct(F.when(local, F.col("latency")).otherwise(float("inf")), F.col("label")),
        ).alias("fastest"),
        F.min(F.when(local, F.col("latency"))).alias("fastest_latency"),
    )


def pending_pairs(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """(model, dataset) pairs not summarised yet."""
    return pairs.join(done.select(*PAIR), list(PAIR), "left_anti")


def common_datasets(metrics: DataFrame, models: DataFrame) -> DataFrame:
    """Datasets completed by every model of `models`."""
    wanted = models.select("model").distinct()
    needed = wanted.agg(F.count(F.lit(1)).alias("needed"))
    done = (
        metrics.select(*PAIR)
        .join(wanted, "model", "left_semi")
        .groupBy("dataset")
        .agg(F.count_distinct("model").alias("models"))
    )
    return done.join(needed, F.col("models") == F.col("needed")).select("dataset")


def merge_runs(runs: Sequence[DataFrame], key: str = "model") -> DataFrame:
    """Union of runs' rows; the first run that has a key wins."""
    tagged = [df.withColumn("run_order", F.lit(i)) for i, df in enumerate(runs)]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    return first_wins(union, [key], "run_order").drop("run_order")


def supplement(first: DataFrame, second: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Rows of `first`, completed by the keys only `second` has."""
    return first.unionByName(second.join(first.select(*keys), list(keys), "left_anti"))


def patch(scores: DataFrame, patches: DataFrame) -> DataFrame:
    """Replace single dataset values and their normalised scores.

    `patches` has model, dataset, value; the caller recomputes the roll-up.
    """
    new = patches.select(*PAIR, F.col("value").alias("new_value"))
    return (
        scores.join(new, list(PAIR), "left")
        .withColumns(
            {
                "value": F.coalesce("new_value", "value"),
                "normalized": F.coalesce("new_value", "normalized"),
            }
        )
        .drop("new_value")
    )


def method_table(groups: DataFrame, tasks: DataFrame, latency: DataFrame) -> DataFrame:
    """Comparison of methods: per-task score, overall, size and latency.

    `groups` has method, size, one model id per task (`<task>_model`) and
    optional literal scores (`<task>_literal`) that win over looked-up ones.
    Latency is item-weighted over the group's distinct models.
    """
    ids = F.array(
        *[
            F.struct(
                F.lit(t).alias("task"),
                F.col(f"{t}_model").alias("model"),
                F.col(f"{t}_literal").cast("double").alias("literal"),
            )
            for t in TASKS
        ]
    )
    long = groups.select("method", "size", F.inline(ids))
    scored = (
        long.join(tasks.select("model", "task", "score"), ["model", "task"], "left")
        .withColumn("final", F.coalesce("literal", "score"))
        .groupBy("method")
        .agg(
            F.first("size").alias("size"),
            *[F.max(F.when(F.col("task") == t, F.col("final"))).alias(t) for t in TASKS],
            F.avg("final").alias("overall"),
        )
    )
    per_method = (
        long.select("method", "model").distinct().join(latency, "model")
        .groupBy("method")
        .agg(
            ratio_or_null(
                F.sum(F.col("mean_latency_ms") * F.col("items")), F.sum("items")
            ).alias("latency_ms")
        )
    )
    return scored.join(per_method, "method", "left")


def relabel(predictions: DataFrame, gold: DataFrame, keys: Sequence[str] = ("dataset", "id")) -> DataFrame:
    """Predictions with corrected gold and `flipped`; an unknown id is an error.

    Scores and predicted indices stay untouched.
    """
    fixed = gold.select(*keys, F.col("gold_index").alias("new_gold"))
    joined = require(
        predictions.join(fixed, list(keys), "left"),
        F.col("new_gold").isNotNull(),
        "no corrected gold for a prediction",
    )
    flipped = (F.col("new_gold") != F.col("gold_index")).alias("flipped")
    kept = [F.col(c) for c in predictions.columns if c != "gold_index"]
    return joined.select(*kept, F.col("new_gold").alias("gold_index"), flipped)


def exclude(scores: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Leave diagnostic datasets out of the primary score."""
    return scores.filter(~F.col("dataset").isin(list(datasets)))


