"""Item and prediction views over the star-schema tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators.items import score_items, yes_no_items
from gavel.operators.metrics import summarize
from gavel.operators.scoring import mock_scores
from gavel.schemas import ITEM_COLUMNS, validate_items

MODELS = tuple(f"m{i}" for i in range(6))
YES_NO_TEMPLATES = {
    "toxic": "次の文章は有害ですか？\n文章: {text}",
    "quality": "次の文章は高品質ですか？\n文章: {text}",
}
EVENT_PROMPT = "次の値の大きさを五段階で評価してください。"
EVENT_CRITERIA = ["L0", "L1", "L2", "L3", "L4"]
EVENT_THRESHOLDS = [100, 200, 300, 400]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Selected columns of a table."""
    return table(spark, sf_dir, name).select(*columns)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles at nine digits, the precision the results are compared at."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in columns})


def items_noul(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """Yes/no items: is the document toxic (or of high quality)?"""
    rows = wide_table(spark, sf_dir, "documents", "doc_id", "text").join(
        table(spark, sf_dir, "labels").select("doc_id", label), "doc_id"
    )
    source = {
        "gold_field": label,
        "positive_values": [1],
        "question_template": YES_NO_TEMPLATES[label],
        "item_id_field": "doc_id",
    }
    return yes_no_items(rows, label, source)


def items_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal items: the size of an event's value on five levels, one dataset per type."""
    events = wide_table(spark, sf_dir, "events", "event_id", "event_type", "value")
    rows = events.select(
        F.concat_ws(":", "event_id", "event_type").alias("id"),
        F.concat_ws(" ", "event_type", F.round(F.col("value") * 100).cast("bigint")).alias("state"),
        F.col("value").alias("gold_score"),
    )
    items = score_items(
        rows,
        "value",
        {"criteria": EVENT_CRITERIA, "gold_thresholds": EVENT_THRESHOLDS, "prompt": EVENT_PROMPT},
    )
    # One pass over all types: the dataset follows from the id's type part.
    kind = F.substring_index("id", ":", -1)
    return items.withColumns({"dataset": F.concat(F.lit("value_"), kind)})


def items_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-option items: an order's priority, answered by its 1-based number."""
    from gavel.functions.text import answer_index

    orders = wide_table(
        spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    dataset = F.concat(F.lit("prio_"), F.col("o_orderstatus"))
    options = F.array(*[F.lit(p) for p in PRIORITIES])
    answer = F.substring("o_orderpriority", 1, 1)
    built = orders.select(
        dataset.alias("dataset"),
        F.lit("choice").alias("task"),
        F.concat(dataset, F.lit(":"), F.col("o_orderkey")).alias("id"),
        F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of customer "), F.col("o_custkey")).alias("question"),
        options.alias("options"),
        answer_index(answer, orders.schema["o_orderpriority"].dataType, options).alias("gold_index"),
        F.create_map(F.lit("dataset"), dataset).alias("metadata"),
    )
    return validate_items(built)


def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        items_noul(spark, sf_dir),
        items_noul(spark, sf_dir, "quality"),
        items_score(spark, sf_dir),
        items_choice(spark, sf_dir),
    ]
    return reduce(DataFrame.unionByName, [p.select(*ITEM_COLUMNS) for p in parts])


def predict(items: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Every model's mock predictions, with latency and token usage taken from the digest."""
    per_model = items.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    salted = F.concat("model", F.lit(":"), "question")
    per_model = per_model.withColumn("__digest", F.sha2(salted, 256))
    scored = mock_scores(per_model, digest=F.col("__digest"))
    return scored.select(
        "model", "dataset", "task", "id", "gold_index", "predicted_index", "scores",
        "probabilities",
        (_last_byte(F.col("__digest")) / 10).alias("latency_ms"),
        F.struct(
            F.struct(
                F.length("question").cast("bigint").alias("input_tokens"),
                F.lit(1).cast("bigint").alias("output_tokens"),
            ).alias("usage")
        ).alias("score_metadata"),
    )


def _last_byte(digest: Column) -> Column:
    return F.conv(F.substring(digest, 63, 2), 16, 10).cast("double")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(all_items(spark, sf_dir))


# (model, dataset) results left out, so that partial and unavailable tasks occur.
MISSING = (
    ("m1", "toxic"),
    ("m2", "value_click"),
    ("m2", "value_view"),
    ("m3", "prio_F"),
    ("m3", "prio_O"),
    ("m3", "prio_P"),
    ("m5", "toxic"),
    ("m5", "quality"),
)
TASK_METRIC = {
    "noul": "f1",
    "choice": "accuracy",
    "score": "normalized_quadratic_weighted_kappa",
}


def keep_present(df: DataFrame) -> DataFrame:
    missing = reduce(
        lambda a, b: a | b,
        [(F.col("model") == m) & (F.col("dataset") == d) for m, d in MISSING],
    )
    return df.filter(~missing)


def dataset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric roll-up of the predictions; absent results are dropped before any work."""
    return summarize(keep_present(preds(spark, sf_dir)))


def every_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric roll-up of all predictions."""
    return summarize(preds(spark, sf_dir))


def every_quick_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric roll-up of all predictions without latency percentiles."""
    from gavel.operators.metrics import finalize, metric_cells

    return finalize(metric_cells(preds(spark, sf_dir)))


def quick_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric roll-up without latency percentiles, for leaderboard queries."""
    from gavel.operators.metrics import finalize, metric_cells

    return finalize(metric_cells(keep_present(preds(spark, sf_dir))))


def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (model, task, dataset) of the item table with its task metric."""
    datasets = (
        table(spark, sf_dir, "events")
        .select(F.concat(F.lit("value_"), "event_type").alias("dataset"), F.lit("score").alias("task"))
        .distinct()
        .unionByName(
            table(spark, sf_dir, "orders")
            .select(
                F.concat(F.lit("prio_"), "o_orderstatus").alias("dataset"),
                F.lit("choice").alias("task"),
            )
            .distinct()
        )
        .unionByName(
            spark.range(1).select(
                F.explode(F.array(F.lit("toxic"), F.lit("quality"))).alias("dataset"),
                F.lit("noul").alias("task"),
            )
        )
    )
    metric = F.coalesce(*[F.when(F.col("task") == t, m) for t, m in TASK_METRIC.items()])
    return datasets.select(
        F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"),
        "task",
        "dataset",
        metric.alias("metric"),
        F.lit(4.0).alias("max_error"),
    )
