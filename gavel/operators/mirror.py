"""Publishable mirror of items with their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.schemas import TASKS

# Published task labels and column order.
TASK_LABELS = {"noul": "Noul", "choice": "Choice", "score": "Score"}
MIRROR_COLUMNS = (
    "id", "primitive", "dataset_id", "source_dataset", "source_repo", "source_url",
    "source_split", "source_license", "question", "options", "gold_index", "metadata",
)


def override_specs(base: DataFrame, override: DataFrame, key: str = "dataset") -> DataFrame:
    """Dataset specifications where a later source replaces an earlier one."""
    return override.unionByName(base.join(override.select(key), key, "left_anti"))


def provenance(catalog: DataFrame) -> DataFrame:
    """One row per mirrored profile dataset with where it comes from."""
    s = F.col("source")
    repo = F.coalesce(
        s["derived_from"]["repo_id"],
        F.nullif(s["repo_id"], F.lit("")),
        F.nullif(s["url"], F.lit("")),
        F.col("manifest_repo"),
    )
    return catalog.filter(~F.col("gated") & (F.col("distribution") == "mirror")).select(
        F.explode("profile_datasets").alias("dataset"),
        F.col("title").alias("source_dataset"),
        repo.alias("source_repo"),
        F.col("url").alias("source_url"),
        F.coalesce(F.nullif(s["split"], F.lit("")), F.lit("(none)")).alias("source_split"),
        F.col("license").alias("source_license"),
    )


def mirror_rows(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items of mirrored datasets in the publishable 12-column shape."""
    id_ = F.when(F.col("id").startswith(F.col("dataset")), F.col("id")).otherwise(
        F.concat("dataset", F.lit(":"), "id")
    )
    label = F.coalesce(*[F.when(F.col("task") == t, v) for t, v in TASK_LABELS.items()])
    extra = F.map_filter("metadata", lambda k, _: k != "criteria")
    joined = items.join(provenance(catalog), "dataset")
    return joined.select(
        id_.alias("id"),
        label.alias("primitive"),
        F.col("dataset").alias("dataset_id"),
        "source_dataset",
        "source_repo",
        "source_url",
        "source_split",
        "source_license",
        "question",
        "options",
        "gold_index",
        F.to_json(extra).alias("metadata"),
    )


def mirror_subsets(rows: DataFrame) -> dict[str, DataFrame]:
    """The three task subsets and `all`, their bag union."""
    parts = {t: rows.filter(F.col("primitive") == TASK_LABELS[t]) for t in TASKS}
    union = parts["noul"].unionByName(parts["choice"]).unionByName(parts["score"])
    return {**parts, "all": union}


def mirror_counts(rows: DataFrame) -> DataFrame:
    """Rows per (subset, dataset); `all` repeats every row, before any shuffle of rows."""
    subset = F.explode(F.array(F.lower("primitive"), F.lit("all"))).alias("subset")
    per_dataset = rows.groupBy("primitive", "dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return per_dataset.select(subset, "dataset_id", "n").groupBy("subset", "dataset_id").agg(
        F.sum("n").alias("rows")
    )
