"""Writers for predictions, metrics, leaderboards, mirrors and corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators.corpus import trainer_rows
from gavel.operators.mirror import mirror_subsets


SHARES = 32  # parts of a directory that its rows are dealt to


def is_empty_target(spark: SparkSession, path: str) -> bool:
    """True for an absent path and for a directory without entries."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return not fs.exists(hadoop) or len(fs.listStatus(hadoop)) == 0


def _claim(spark: SparkSession, path: str) -> None:
    """Never overwrite a run; an empty directory left by a failed one is reusable."""
    if not is_empty_target(spark, path):
        raise FileExistsError(f"run directory is not empty: {path}")


def _gathered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of one output directory brought together before a partitioned write.

    A rebalance, unlike a plain repartition, lets AQE split a directory that
    holds a large share of the rows and merge the small ones. It cannot split what one
    task gave to one partition, so rows with an `id` are dealt to SHARES parts of
    their directory: a task's sort before the write holds a part, not all of a task's rows.
    """
    if "id" not in df.columns:
        return df.hint("rebalance", *by)
    share = F.pmod(F.xxhash64("id"), F.lit(SHARES))
    return df.withColumn("__share", share).hint("rebalance", *by, "__share").drop("__share")


def write_predictions(
    df: DataFrame, path: str, by: Sequence[str] = ("run", "model", "dataset"),
    fmt: str = "parquet",
) -> None:
    """Predictions by run, model and dataset; Parquet, or JSON lines on request."""
    _claim(df.sparkSession, path)
    # The directory was just checked: append keeps an empty one.
    _gathered(df, by).write.mode("append").partitionBy(*by).format(fmt).save(path)


def write_items(df: DataFrame, path: str) -> None:
    """Items of a run as Parquet, as they lie: whole texts are neither shuffled nor sorted."""
    _claim(df.sparkSession, path)
    df.write.mode("append").parquet(path)


def write_run_metadata(df: DataFrame, path: str) -> None:
    """One JSON line per run."""
    _claim(df.sparkSession, path)
    df.write.mode("append").json(path)


def write_summaries(metrics: DataFrame, path: str) -> None:
    """Dataset metrics by task, sorted by dataset inside each file."""
    _claim(metrics.sparkSession, path)
    ordered = metrics.repartition("task").sortWithinPartitions("task", "dataset")
    ordered.write.mode("append").partitionBy("task").json(path)


def leaderboard_json(
    board: DataFrame, tasks: DataFrame, scores: DataFrame, phase: str = "production"
) -> DataFrame:
    """One nested JSON document per model: model -> tasks -> datasets."""
    datasets = scores.filter(F.col("normalized").isNotNull()).groupBy("model", "task").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "dataset",
                    *[c for c in ("feature",) if c in scores.columns],
                    "metric", "value", F.col("normalized").alias("normalized_score"), "total",
                )
            )
        ).alias("datasets")
    )
    body = F.struct(
        "status",
        F.col("score"),
        F.col("completed").alias("completed_datasets"),
        F.col("configured").alias("configured_datasets"),
        "datasets",
    )
    nested = (
        tasks.join(datasets, ["model", "task"], "left")
        .groupBy("model")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", body)))).alias("primitives"))
    )
    document = F.struct(
        F.col("model").alias("id"),
        "primitives",
        F.col("overall").alias("overall_score"),
        "overall_status",
        F.col("coverage").alias("primitive_coverage"),
        F.lit(phase).alias("phase"),
    )
    return board.join(nested, "model").select("model", F.to_json(document).alias("document"))


def write_leaderboard(documents: DataFrame, path: str) -> None:
    _claim(documents.sparkSession, path)
    documents.select(F.col("document").alias("value")).write.mode("append").text(path)


def write_mirror(rows: DataFrame, path: str) -> None:
    """Task subsets as Parquet partitions; `all` is the unfiltered read of the same files."""
    _claim(rows.sparkSession, path)
    _gathered(rows, ["primitive"]).write.mode("append").partitionBy("primitive").parquet(path)


def write_mirror_subsets(rows: DataFrame, path: str) -> None:
    """Each subset, `all` included, as its own Parquet dataset.

    The rows are built once, into the partitioned form; the subsets copy it.
    """
    spark = rows.sparkSession
    write_mirror(rows, f"{path}/by_primitive")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/by_primitive").select(rows.columns)
    for name, part in mirror_subsets(stored).items():
        part.write.mode("errorifexists").parquet(f"{path}/{name}")


def append_status(df: DataFrame, path: str) -> None:
    """Run status rows (disabled, no_datasets, partial, complete) with their skipped list."""
    df.write.mode("append").json(path)


def run_status(runs: DataFrame, skipped: DataFrame) -> DataFrame:
    """Status per run: disabled, no_datasets, partial or complete; with the `reason` of what was skipped, if given."""
    reasons = [F.array_sort(F.collect_set(F.struct("dataset", "reason"))).alias("reasons")] if "reason" in skipped.columns else []
    counts = skipped.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("dataset")).alias("skipped"), *reasons
    )
    status: Column = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("datasets") == 0, "no_datasets")
        .when(F.coalesce("n", F.lit(0)) > 0, "partial")
        .otherwise("complete")
    )
    return runs.join(counts, "run", "left").withColumn("status", status).drop("n")


def write_trainer_files(items: DataFrame, path: str, split: str = "split") -> None:
    """`{context, options, label}` JSON lines, one directory per split."""
    _claim(items.sparkSession, path)
    rows = trainer_rows(items).columns
    tagged = items.select(
        F.col("question").alias("context"), "options", F.col("gold_index").alias("label"), split
    )
    _gathered(tagged.select(*rows, split), [split]).write.mode("append").partitionBy(split).json(path)


def write_corpus(examples: DataFrame, path: str) -> None:
    """Training and per-task evaluation corpus."""
    _claim(examples.sparkSession, path)
    by = ("split", "task")
    _gathered(examples, by).write.mode("append").partitionBy(*by).parquet(path)


def write_csv_export(df: DataFrame, path: str) -> None:
    """Ranking or axis table for spreadsheets: every value quoted, UTF-8 BOM, one header.

    An export is a bounded report, so its rows go to one file.
    """

    def quoted(value: Column) -> Column:
        text = F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""'))
        return F.concat(F.lit('"'), text, F.lit('"'))

    header = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    rows = df.select(
        F.concat_ws(",", *[quoted(F.col(f"`{c}`")) for c in df.columns]).alias("value"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = df.sparkSession.range(1).select(F.lit(header).alias("value"), F.lit(-1).alias("line"))
    ordered = first.union(rows).repartition(1).sortWithinPartitions("line").select("value")
    ordered.write.mode("errorifexists").option("lineSep", "\r\n").text(path)


def write_catalog(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").parquet(path)
