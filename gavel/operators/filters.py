"""Row filters and limits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions.text import col, py_str
from gavel.schemas import require


def _literal(value: str, dtype: T.DataType) -> Any:
    """The typed value whose text is `value`; None when no such value exists."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return {"True": True, "False": False}.get(value)
    try:
        if isinstance(dtype, T.IntegralType) and str(int(value)) == value:
            bits = {"byte": 8, "short": 16, "integer": 32, "long": 64}[dtype.typeName()]
            return int(value) if abs(int(value)) < 2 ** (bits - 1) else None
        if isinstance(dtype, T.DoubleType) and repr(float(value)) == value:
            number = float(value)
            return number if number == number and abs(number) != float("inf") else None
    except ValueError:
        pass
    return None


_TYPED = (T.StringType, T.BooleanType, T.IntegralType, T.DoubleType)


def text_in(df: DataFrame, name: str, values: Iterable[Any]) -> Column:
    """str(row[name]) in {str(v)}; NULL and absent columns read as `None`.

    Compiles to a typed comparison wherever the text round-trips through the
    column type, so that it still reaches the Parquet scan.
    """
    texts = sorted({str(v) for v in values})
    if name not in df.columns:
        return F.lit("None" in texts)
    column, dtype = col(name), df.schema[name].dataType
    if isinstance(dtype, _TYPED):
        literals = [x for x in (_literal(t, dtype) for t in texts) if x is not None]
        if isinstance(dtype, T.DoubleType) and any(x == 0 for x in literals):
            # 0.0 and -0.0 are equal as numbers and differ as text
            matched = py_str(column, dtype).isin(texts)
        else:
            matched = column.isin(literals) if literals else F.lit(False)
    else:
        matched = py_str(column, dtype).isin(texts)
    if "None" in texts:
        return column.isNull() | F.coalesce(matched, F.lit(False))
    return matched


def where(df: DataFrame, conditions: Mapping[str, Any]) -> DataFrame:
    """Keep rows whose fields all equal the given values, as text."""
    for name, value in conditions.items():
        df = df.filter(text_in(df, name, [value]))
    return df


def where_in(df: DataFrame, conditions: Mapping[str, Iterable[Any]]) -> DataFrame:
    """Keep rows whose fields are all members of the given sets, as text."""
    for name, values in conditions.items():
        df = df.filter(text_in(df, name, values))
    return df


def where_not(df: DataFrame, conditions: Mapping[str, Any]) -> DataFrame:
    """Drop rows where any field equals its value, as text; NULL fields stay."""
    for name, value in conditions.items():
        df = df.filter(~F.coalesce(text_in(df, name, [value]), F.lit(False)))
    return df


def nested(path: str) -> Column:
    """`a.b.c` as a struct access; an absent path fails while planning."""
    parts = path.split(".")
    return reduce(lambda c, part: c[part], parts[1:], col(parts[0]))


def match_nested(
    df: DataFrame, conditions: Mapping[str, Any], required: bool = False
) -> DataFrame:
    """Equality on nested paths; optionally an error when nothing matches."""
    for path, value in conditions.items():
        df = df.filter(nested(path) == F.lit(value))
    if required and df.isEmpty():
        raise ValueError(f"no row matched filters: {dict(conditions)}")
    return df


def availability(datasets: DataFrame, staged: DataFrame) -> DataFrame:
    """Configured datasets with `available` and the reason of the skipped ones.

    `datasets` has dataset, path and remote (a fetchable source is declared);
    `staged` lists the paths that exist.
    """
    found = staged.select("path").distinct().withColumn("found", F.lit(True))
    available = F.col("remote") | F.coalesce("found", F.lit(False))
    return (
        datasets.join(found, "path", "left")
        .withColumn("available", available)
        .withColumn("reason", F.when(~F.col("available"), "source_not_found"))
        .drop("found")
    )


def extend_skipped(skipped: DataFrame, more: DataFrame) -> DataFrame:
    """Skipped list with new entries, one row per dataset, the earlier reason kept."""
    tagged = skipped.select("dataset", "reason", F.lit(0).alias("turn")).unionByName(
        more.select("dataset", "reason", F.lit(1).alias("turn"))
    )
    return tagged.groupBy("dataset").agg(F.min_by("reason", "turn").alias("reason"))


def unknown_ids(selected: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Selected ids that are not known."""
    return selected.select(key).distinct().join(known.select(key), key, "left_anti")


def require_known(selected: DataFrame, known: DataFrame, key: str) -> None:
    """Unknown ids in a selection are an error that lists them, sorted."""
    row = (
        unknown_ids(selected, known, key)
        .agg(F.array_join(F.array_sort(F.collect_set(key)), ", ").alias("ids"))
        .first()
    )
    if row and row["ids"]:
        raise ValueError(f"unknown {key}: {row['ids']}")


def select_enabled(
    config: DataFrame, selection: DataFrame | None, key: str, task: str | None = None
) -> DataFrame:
    """Enabled rows of a configuration table, restricted to a selection and a task."""
    df = config.filter(F.coalesce("enabled", F.lit(True)))
    if task is not None:
        df = df.filter(F.coalesce("task", F.lit("choice")) == task)
    if selection is not None:
        df = df.join(selection.select(key).distinct(), key, "left_semi")
    return df


def ranking_filter(
    models: DataFrame,
    metric: str,
    tags: list[str],
    min_size: float = 0.0,
    max_size: float = float("inf"),
    include_unsized: bool = True,
) -> DataFrame:
    """Size range, unsized (service) models, any matching variant tag, metric present."""
    size_ok = F.when(F.col("size").isNull(), F.lit(include_unsized)).otherwise(
        F.col("size").between(min_size, max_size)
    )
    wanted = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    return models.filter(
        col(metric).isNotNull() & size_ok & F.arrays_overlap(F.col("tags"), wanted)
    )


def require_in_range(df: DataFrame, column: str, low: float, high: float, name: str) -> DataFrame:
    value = col(column)
    return require(df, value.isNull() | value.between(low, high), f"{name} is out of range")
