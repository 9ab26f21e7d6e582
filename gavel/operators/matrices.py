"""Series x axis comparison tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.operators.filters import match_nested, nested
from gavel.operators.leaderboard import common_datasets, metric_value
from gavel.schemas import TASKS, require


def fraction(value: Column, scale: str = "fraction") -> Column:
    """Percent or fraction -> 0-1; anything outside is an error."""
    if scale not in ("fraction", "percent"):
        raise ValueError(f"unsupported input_scale: {scale}")
    number = value.cast("double") / (100.0 if scale == "percent" else 1.0)
    return F.when(number.between(0.0, 1.0), number).otherwise(
        F.raise_error(F.lit("value must normalize to the 0-1 range")).cast("double")
    )


def series_matrix(
    results: DataFrame,
    series: str,
    axes: Sequence[str],
    axis: str = "dataset",
    metric: str = "accuracy",
    scale: str = "fraction",
) -> DataFrame:
    """One row per series, one column per axis; repeated or missing axes are errors."""
    name = nested(axis).cast("string")
    points = (
        results.filter(name.isin(list(axes)))
        .groupBy(F.col(series).alias("series"), name.alias("axis"))
        .agg(F.count(F.lit(1)).alias("n"), F.first(nested(metric)).alias("value"))
    )
    points = require(
        points, F.col("n") == 1, F.concat(F.lit("duplicate axis: "), F.col("axis"))
    ).withColumn("value", fraction(F.col("value"), scale))
    wide = points.groupBy("series").pivot("axis", list(axes)).agg(F.first("value"))
    complete = reduce(lambda a, b: a & b, [F.col(f"`{a}`").isNotNull() for a in axes])
    return require(
        wide, complete, F.concat(F.lit("series lacks axes: "), F.col("series").cast("string"))
    )


def single_point(
    results: DataFrame, conditions: dict, metric: str, scale: str = "fraction"
) -> DataFrame:
    """Exactly one matching row gives the point."""
    matched = match_nested(results, conditions).agg(
        F.count(F.lit(1)).alias("n"), F.first(nested(metric)).alias("value")
    )
    checked = require(matched, F.col("n") == 1, "point must match exactly one row")
    return checked.select(fraction(F.col("value"), scale).alias("value"))


def common_matrix(metrics: DataFrame, models: DataFrame, metric: str) -> DataFrame:
    """(model, dataset, value) over the datasets every model has completed."""
    shared = common_datasets(metrics, models)
    chosen = metrics.join(models.select("model").distinct(), "model", "left_semi")
    return chosen.join(shared, "dataset", "left_semi").select(
        "model", "dataset", F.col(metric).alias("value")
    )


def summary_matrix(board: DataFrame) -> DataFrame:
    """Task scores and overall in long form, for models with every task available."""
    axes = [*TASKS, "overall"]
    pairs = F.array(
        *[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes]
    )
    return board.filter(F.col("available") == len(TASKS)).select("model", F.inline(pairs))


def task_matrix(
    metrics: DataFrame, task: str, axes: Sequence[str], metric: str
) -> DataFrame:
    """Models x fixed dataset list of one task."""
    value = metric_value(F.lit(metric), metrics.columns)
    rows = metrics.filter((F.col("task") == task) & F.col("dataset").isin(list(axes)))
    return (
        rows.select("model", "dataset", value.alias("value"))
        .groupBy("model")
        .pivot("dataset", list(axes))
        .agg(F.first("value"))
    )
