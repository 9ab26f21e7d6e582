"""Queries over items and predictions: every dataset metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators import metrics as M
from gavel.plans import views as V
from gavel.plans.registry import query
from gavel.plans.sql_views import byte, r9, sql


_noul_sql = dict(
    flagship=f"""
SELECT model, gold_index AS g, s.predicted AS p, s.pg AS pg, s.other AS other FROM (
  SELECT model, gold_index, CASE WHEN b >= a THEN 1 ELSE 0 END AS first_best,
         CASE WHEN b > a THEN 1 ELSE 0 END AS predicted,
         CASE WHEN gold_index = 1 THEN b ELSE a END / (a + b) AS pg,
         CASE WHEN gold_index = 1 THEN a ELSE b END / (a + b) AS other
  FROM (SELECT model, gold_index, {byte("h", "0")} + 1.0::DOUBLE AS a, {byte("h", "1")} + 1.0::DOUBLE AS b
        FROM (SELECT model, gold_index, sha256(model || ':' || question) AS h
              FROM items_noul, (SELECT unnest(['m0', 'm1', 'm2']) AS model)))) s"""
)


# Metric queries cover every result; only coverage and leaderboard queries leave some out.
EVERY = {"present": "SELECT * FROM preds"}


@query(
    sql(
        f"""
SELECT model, count(*) AS total, count(*) FILTER (WHERE p = g) AS correct,
       {r9("accuracy", "avg((p = g)::INT)")},
       {r9("f1", "2 * count(*) FILTER (WHERE p = 1 AND g = 1) / (2 * count(*) FILTER (WHERE p = 1 AND g = 1) + count(*) FILTER (WHERE p <> g))")},
       {r9("nll", "-avg(ln(greatest(pg, 1e-12)))")},
       {r9("brier_score", "avg((1 - pg) * (1 - pg) + other * other)")}
FROM flagship GROUP BY model""",
        **_noul_sql,
    )
)
def noul_toxic_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items from documents and labels, mock-scored by three models, evaluated."""
    predictions = V.predict(V.items_noul(spark, sf_dir), ("m0", "m1", "m2"))
    out = M.finalize(M.metric_cells(predictions))
    columns = ("accuracy", "f1", "nll", "brier_score")
    return V.rounded(out.select("model", "total", "correct", *columns), *columns)


@query(sql(f"SELECT model, dataset, task, {r9('ece')}, {r9('nll')} FROM dm", **EVERY))
def noul_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of every model and dataset."""
    out = V.every_quick_metric(spark, sf_dir).select("model", "dataset", "task", "ece", "nll")
    return V.rounded(out, "ece", "nll")


_ORDINAL = ("mae", "rmse", "quadratic_weighted_kappa", "normalized_quadratic_weighted_kappa")


def _ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = V.predict(V.items_score(spark, sf_dir))
    return M.finalize(M.metric_cells(predictions))


@query(
    sql(
        f"SELECT model, dataset, total, {', '.join(r9(c) for c in _ORDINAL)} "
        "FROM dm WHERE task = 'score'",
        **EVERY,
    )
)
def score_ordinal_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal agreement of threshold-labelled events."""
    out = _ordinal(spark, sf_dir).select("model", "dataset", "total", *_ORDINAL)
    return V.rounded(out, *_ORDINAL)


@query(sql(f"SELECT model, dataset, {r9('spearman')} FROM dm WHERE task = 'score'", **EVERY))
def score_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation with tie-averaged ranks, from the joint histogram."""
    out = _ordinal(spark, sf_dir).select("model", "dataset", "spearman")
    return V.rounded(out, "spearman")


@query(
    sql(
        """
SELECT c.model, c.dataset, c.g AS gold_index, c.p AS predicted_index, c.n::BIGINT AS n,
       a.n::BIGINT AS gold_total, b.n::BIGINT AS predicted_total
FROM cells c JOIN golds a USING (model, dataset, task, g)
JOIN guesses b USING (model, dataset, task, p) WHERE c.task = 'score'""",
        **EVERY,
    )
)
def score_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix with marginals."""
    predictions = V.predict(V.items_score(spark, sf_dir))
    return M.confusion(predictions).drop("task")


@query(
    sql(
        "SELECT model, dataset, gold_index, "
        + ", ".join(f"count(*) FILTER (WHERE predicted_index = {i}) AS p{i}" for i in range(5))
        + " FROM present WHERE task = 'score' GROUP BY ALL",
        **EVERY,
    )
)
def score_confusion_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix with one column per predicted level."""
    predictions = V.predict(V.items_score(spark, sf_dir))
    return M.confusion_wide(predictions, 5).drop("task")


@query(sql(f"SELECT model, dataset, correct, total, {r9('accuracy')} FROM dm WHERE task = 'choice'", **EVERY))
def choice_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1 accuracy of five-option items."""
    predictions = V.predict(V.items_choice(spark, sf_dir))
    out = M.finalize(M.metric_cells(predictions))
    return V.rounded(out.select("model", "dataset", "correct", "total", "accuracy"), "accuracy")


_LATENCY = (
    "mean_latency_ms", "p50_latency_ms", "p95_latency_ms", "throughput_items_per_second",
)


@query(sql(f"SELECT model, dataset, {', '.join(r9(c) for c in _LATENCY)} FROM dm", **EVERY))
def latency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, exact p50 / p95 and throughput."""
    out = V.every_metric(spark, sf_dir).select("model", "dataset", *_LATENCY)
    return V.rounded(out, *_LATENCY)


@query(
    sql(
        f"""
SELECT l_returnflag AS model, l_linestatus AS dataset, count(*) AS n,
       {r9("p50_latency_ms", "quantile_cont(l_extendedprice, 0.5)")},
       {r9("p95_latency_ms", "quantile_cont(l_extendedprice, 0.95)")}
FROM lineitem GROUP BY ALL"""
    )
)
def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of nearly unique values in few large groups."""
    from gavel.operators import percentiles as P

    rows = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("dataset"),
        F.col("l_extendedprice").alias("latency_ms"),
    )
    keys = ["model", "dataset"]
    out = P.percentiles(P.value_cells(rows, keys), keys, M.LATENCY_FRACTIONS)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return V.rounded(M.attach(counts, out, keys), *M.LATENCY_FRACTIONS)


@query(
    sql(
        f"""
SELECT model, dataset, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens,
       total_tokens::BIGINT AS total_tokens, {r9("mean_tokens_per_item")},
       {r9("estimated_cost", "input_tokens / 1000000 * 0.042")} FROM dm""",
        **EVERY,
    )
)
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums, mean per item and the cost estimate."""
    out = M.api_cost(V.every_quick_metric(spark, sf_dir), 0.042)
    return V.rounded(
        out.select(
            "model", "dataset", "input_tokens", "output_tokens", "total_tokens",
            "mean_tokens_per_item", "estimated_cost",
        ),
        "mean_tokens_per_item", "estimated_cost",
    )


_ALL = (
    "accuracy", "mean_latency_ms", "p50_latency_ms", "p95_latency_ms", "nll", "brier_score", "ece",
    "precision", "recall", "f1", "mae", "rmse", "spearman", "quadratic_weighted_kappa",
    "normalized_quadratic_weighted_kappa",
)


@query(
    sql(f"SELECT model, dataset, task, correct, total, {', '.join(r9(c) for c in _ALL)} FROM dm", **EVERY)
)
def task_dispatch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole summary: each task gets its own metric set, the rest stays NULL."""
    out = V.every_metric(spark, sf_dir)
    return V.rounded(out.select("model", "dataset", "task", "correct", "total", *_ALL), *_ALL)


_EMPTY = ("accuracy", "f1", "mae", "rmse", "spearman", "normalized_quadratic_weighted_kappa")


def _default(metric: str, task: str, value: float) -> str:
    return (
        f"round(CAST(CASE WHEN m.total IS NULL AND c.task = '{task}' THEN {value} "
        f"ELSE m.{metric} END AS DOUBLE), 9) AS {metric}"
    )


@query(
    sql(
        f"""
SELECT c.model, c.dataset, c.task, coalesce(m.total, 0) AS total,
       {r9("accuracy", "coalesce(m.accuracy, 0)")}, {_default("f1", "noul", 0.0)},
       {_default("mae", "score", 0.0)}, {_default("rmse", "score", 0.0)},
       {_default("spearman", "score", 0.0)},
       {_default("normalized_quadratic_weighted_kappa", "score", 0.5)}
FROM configured c LEFT JOIN dm m USING (model, dataset, task)"""
    )
)
def empty_group_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured groups without rows carry the metrics of an empty set."""
    groups = V.configured(spark, sf_dir).select("model", "dataset", "task")
    out = M.with_empty_groups(groups, V.quick_metrics(spark, sf_dir), M.KEYS)
    return V.rounded(out.select("model", "dataset", "task", "total", *_EMPTY), *_EMPTY)
