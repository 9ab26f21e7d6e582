"""Incremental evaluation: fold newly arrived predictions into mergeable sums.

The state is an append-only set of metric and latency cells, one directory per
micro-batch. A retried batch overwrites its own directory, and the stream's
checkpoint remembers the files already taken, so every prediction counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators.metrics import (
    KEYS,
    LATENCY_FRACTIONS,
    attach,
    finalize,
    merge_cells,
    metric_cells,
    throughput,
)
from gavel.operators.percentiles import merge_value_cells, percentiles, value_cells
from gavel.schemas import PREDICTION, validate_predictions


def _paths(state: str) -> tuple[str, str]:
    return f"{state}/metric_cells", f"{state}/latency_cells"


def ingest(
    spark: SparkSession,
    source: str,
    state: str,
    checkpoint: str,
    fmt: str = "parquet",
    schema: str = PREDICTION,
    keys: Sequence[str] = KEYS,
    max_files: int | None = None,
) -> None:
    """Take every prediction file not seen before, then stop."""
    metric_path, latency_path = _paths(state)

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = validate_predictions(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:  # both kinds of cells from one read
            for cells, path in (
                (metric_cells(rows, keys), metric_path),
                (value_cells(rows, keys), latency_path),
            ):
                cells.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            rows.unpersist()

    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = (
        reader.load(source)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_metrics(
    spark: SparkSession, state: str, keys: Sequence[str] = KEYS, task: str = "task"
) -> DataFrame:
    """Metrics of everything ingested so far; percentiles stay exact."""
    metric_path, latency_path = _paths(state)
    cells = merge_cells(spark.read.parquet(metric_path), keys)
    latency = merge_value_cells(spark.read.parquet(latency_path), keys)
    profile = percentiles(latency, keys, LATENCY_FRACTIONS)
    wide = attach(finalize(cells, keys, task), profile, keys)
    return throughput(wide, F.col("sum_latency_ms") / 1000)


def compact(spark: SparkSession, state: str, target: str, keys: Sequence[str] = KEYS) -> None:
    """Merge all batches of a state into one batch of a new state directory."""
    metric_path, latency_path = _paths(state)
    new_metric, new_latency = _paths(target)
    merge_cells(spark.read.parquet(metric_path), keys).write.parquet(f"{new_metric}/batch_id=-1")
    merge_value_cells(spark.read.parquet(latency_path), keys).write.parquet(
        f"{new_latency}/batch_id=-1"
    )
