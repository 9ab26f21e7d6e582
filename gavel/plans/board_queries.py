"""Queries from dataset metrics to leaderboards and comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators import filters as W
from gavel.operators import leaderboard as L
from gavel.operators import matrices as X
from gavel.operators import metrics as M
from gavel.plans import views as V
from gavel.plans.registry import query
from gavel.plans.sql_views import r9, sql

WEIGHTS = {"noul": 2.0, "choice": 1.0, "score": 1.0}
TASK_COLUMNS = ("noul", "choice", "score")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dataset_scores(V.configured(spark, sf_dir), V.quick_metrics(spark, sf_dir))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.task_scores(_scores(spark, sf_dir))


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.leaderboard(_tasks(spark, sf_dir), WEIGHTS, order=False)


@query(
    sql(
        f"SELECT model, task, {r9('score')}, completed, configured, status FROM tasks"
    )
)
def task_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro mean per (model, task) with complete / partial / unavailable status."""
    return V.rounded(_tasks(spark, sf_dir), "score")


@query(
    sql(
        f"SELECT model, {', '.join(r9(c) for c in (*TASK_COLUMNS, 'overall'))}, overall_status, "
        "coverage FROM board ORDER BY coalesce(overall, 0) DESC, model"
    )
)
def macro_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured datasets, normalised metrics, macro means, weighted overall."""
    board = L.leaderboard(_tasks(spark, sf_dir), WEIGHTS)
    out = board.select("model", *TASK_COLUMNS, "overall", "overall_status", "coverage")
    return V.rounded(out, *TASK_COLUMNS, "overall")


_NORMAL = {
    "accuracy": "accuracy",
    "spearman": "least(greatest((spearman + 1) / 2, 0), 1)",
    "quadratic_weighted_kappa": "least(greatest((quadratic_weighted_kappa + 1) / 2, 0), 1)",
    "mae": "greatest(0, 1 - mae / 4)",
    "rmse": "greatest(0, 1 - rmse / 4)",
}


@query(
    sql(
        " UNION ALL ".join(
            f"SELECT model, dataset, '{m}' AS metric, {r9('value', m)}, {r9('normalized', e)} "
            "FROM dm WHERE task = 'score'"
            for m, e in _NORMAL.items()
        )
    )
)
def metric_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ordinal metric on the 0-1 scale."""
    predictions = V.keep_present(V.predict(V.items_score(spark, sf_dir)))
    metrics = M.finalize(M.metric_cells(predictions))
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _NORMAL]
    )
    long = metrics.select("model", "dataset", F.inline(pairs))
    score = L.normalized(F.col("metric"), F.col("value"), F.lit(4.0), F.col("dataset"))
    return V.rounded(long.withColumn("normalized", score), "value", "normalized")


_COMMON = "SELECT dataset FROM dm GROUP BY dataset HAVING count(DISTINCT model) = 6"


@query(
    sql(
        f"SELECT model, dataset, {r9('value', 'accuracy')} FROM dm WHERE dataset IN ({_COMMON})"
    )
)
def common_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over the datasets that every model has completed."""
    metrics = V.quick_metrics(spark, sf_dir)
    models = V.configured(spark, sf_dir).select("model")
    return V.rounded(X.common_matrix(metrics, models, "accuracy"), "value")


@query(
    sql(
        "SELECT model, dataset FROM configured c WHERE NOT EXISTS "
        "(SELECT 1 FROM dm WHERE dm.model = c.model AND dm.dataset = c.dataset)"
    )
)
def pending_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, dataset) pairs a resumed run still has to do."""
    pairs = V.configured(spark, sf_dir).select("model", "dataset")
    done = V.keep_present(V.preds(spark, sf_dir)).select("model", "dataset").distinct()
    return L.pending_pairs(pairs, done)


@query(
    sql(
        f"""
SELECT model, source, {r9('overall')} FROM (
  SELECT model, 'first' AS source, overall FROM board WHERE model IN ('m0', 'm1', 'm2', 'm4')
  UNION ALL
  SELECT model, 'second', (coalesce(noul, 0) + coalesce(choice, 0) + coalesce(score, 0)) / available
  FROM board WHERE model NOT IN ('m0', 'm1', 'm2', 'm4'))"""
    )
)
def merge_runs_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with overlapping models: the first run that has a model wins."""
    tasks = _tasks(spark, sf_dir)
    first = L.leaderboard(tasks, WEIGHTS, order=False).filter(
        F.col("model").isin("m0", "m1", "m2", "m4")
    )
    second = L.leaderboard(tasks, order=False)
    runs = [
        df.select("model", F.lit(name).alias("source"), "overall")
        for name, df in (("first", first), ("second", second))
    ]
    return V.rounded(L.order_board(L.merge_runs(runs)), "overall")


_GOLD = "CASE WHEN o_orderkey % 4 = 0 THEN 4 - (CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 END"


@query(
    sql(
        f"""
SELECT model, dataset, count(*) AS total, count(*) FILTER (WHERE new_gold <> gold_index) AS flipped,
       {r9("old_accuracy", "avg((predicted_index = gold_index)::INT)")},
       {r9("accuracy", "avg((predicted_index = new_gold)::INT)")},
       {r9("throughput", "count(*) / (sum(latency_ms) / 1000)")}
FROM preds JOIN (SELECT 'prio_' || o_orderstatus || ':' || o_orderkey AS id, {_GOLD} AS new_gold
                 FROM orders) USING (id) GROUP BY model, dataset"""
    )
)
def relabel_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected gold labels applied to stored predictions, accuracy before and after."""
    predictions = V.predict(V.items_choice(spark, sf_dir))
    orders = V.table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    dataset = F.concat(F.lit("prio_"), "o_orderstatus")
    gold = orders.select(
        dataset.alias("dataset"),
        F.concat(dataset, F.lit(":"), "o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 4 == 0, 4 - digit).otherwise(digit).alias("gold_index"),
    )
    fixed = L.relabel(predictions, gold).withColumn(
        "was_right",
        F.when(F.col("flipped"), F.lit(None)).otherwise(
            F.col("predicted_index") == F.col("gold_index")
        ),
    )
    # The old gold is the complement on flipped rows; count it in the same pass.
    old_right = F.when(
        F.col("flipped"), F.col("predicted_index") == 4 - F.col("gold_index")
    ).otherwise(F.col("was_right"))
    out = fixed.groupBy("model", "dataset").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("flipped").alias("flipped"),
        F.avg(old_right.cast("int")).alias("old_accuracy"),
        F.avg((F.col("predicted_index") == F.col("gold_index")).cast("int")).alias("accuracy"),
        (F.count(F.lit(1)) / (F.sum("latency_ms") / 1000)).alias("throughput"),
    )
    return V.rounded(out, "old_accuracy", "accuracy", "throughput")


@query(
    sql(
        f"""
SELECT model, {r9('choice')}, {r9('overall')}, coverage FROM (
  SELECT w.model, p.choice, available || '/3' AS coverage,
    (coalesce(noul, 0) + coalesce(p.choice, 0) + coalesce(w.score, 0)) / available AS overall
  FROM wide w LEFT JOIN (
    SELECT s.model, avg(CASE WHEN s.dataset = 'prio_F' AND s.value IS NOT NULL THEN n.f1 ELSE s.value END) AS choice
    FROM scores s LEFT JOIN (SELECT model, f1 FROM dm WHERE dataset = 'quality') n ON s.model = n.model
    WHERE s.task = 'choice' GROUP BY s.model) p ON w.model = p.model
  WHERE available > 0)""".replace("THEN n.f1 ELSE", "THEN coalesce(n.f1, s.value) ELSE")
    )
)
def patched_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset's value replaced, everything above it recomputed."""
    scores = _scores(spark, sf_dir)
    patches = scores.filter((F.col("dataset") == "quality") & F.col("value").isNotNull()).select(
        "model", F.lit("prio_F").alias("dataset"), "value"
    )
    known = scores.filter(F.col("value").isNotNull()).select("model", "dataset")
    patched = L.patch(scores, patches.join(known, ["model", "dataset"], "left_semi"))
    board = L.leaderboard(L.task_scores(patched), order=False)
    return V.rounded(board.select("model", "choice", "overall", "coverage"), "choice", "overall")


_GROUPS = (
    ("single", "m0", "m0", "m0"),
    ("mixed", "m1", "m4", "m2"),
    ("gappy", "m5", "m3", "m0"),
)
_GROUP_VALUES = " UNION ALL ".join(
    f"SELECT '{g}' AS method, '{a}' AS noul_model, '{b}' AS choice_model, '{c}' AS score_model"
    for g, a, b, c in _GROUPS
)


@query(
    sql(
        f"""
SELECT g.method, {r9("noul", "a.score")}, {r9("choice", "CASE WHEN g.method = 'gappy' THEN 0.5 ELSE b.score END")},
       {r9("score", "c.score")}, {r9("overall", "list_avg(list_filter([a.score, CASE WHEN g.method = 'gappy' THEN 0.5 ELSE b.score END, c.score], lambda x: x IS NOT NULL))")},
       {r9("latency_ms", "(SELECT sum(mean_latency_ms * total) / sum(total) FROM dm WHERE model IN (g.noul_model, g.choice_model, g.score_model))")}
FROM groups g
LEFT JOIN tasks a ON a.model = g.noul_model AND a.task = 'noul'
LEFT JOIN tasks b ON b.model = g.choice_model AND b.task = 'choice'
LEFT JOIN tasks c ON c.model = g.score_model AND c.task = 'score'""",
        groups=_GROUP_VALUES,
    )
)
def method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods built from one model per task, with literal scores and weighted latency."""
    groups = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(g).alias("method"),
                        F.lit(None).cast("double").alias("size"),
                        F.lit(a).alias("noul_model"),
                        F.lit(b).alias("choice_model"),
                        F.lit(c).alias("score_model"),
                        F.lit(None).cast("double").alias("noul_literal"),
                        F.lit(0.5 if g == "gappy" else None).cast("double").alias("choice_literal"),
                        F.lit(None).cast("double").alias("score_literal"),
                    )
                    for g, a, b, c in _GROUPS
                ]
            )
        )
    )
    metrics = V.quick_metrics(spark, sf_dir)
    tasks = L.task_scores(L.dataset_scores(V.configured(spark, sf_dir), metrics))
    out = L.method_table(groups, tasks, L.item_weighted_latency(metrics)).drop("size")
    return V.rounded(out, *TASK_COLUMNS, "overall", "latency_ms")


@query(
    sql(
        f"""
SELECT model, count(*) FILTER (WHERE status = 'complete') AS coverage,
       {r9("provisional", "avg(score) FILTER (WHERE status = 'complete')")},
       {r9("overall", "CASE WHEN count(*) FILTER (WHERE status = 'complete') = 3 THEN avg(score) END")},
       count(*) FILTER (WHERE status = 'complete') <> 3 AS is_provisional
FROM (SELECT model, task, avg(value) AS score,
             CASE WHEN count(value) = count(*) THEN 'complete' ELSE 'partial' END AS status
      FROM scores WHERE dataset <> 'value_error' GROUP BY ALL) GROUP BY model"""
    )
)
def strict_vs_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict overall, and the mean of complete tasks, without a diagnostic dataset."""
    scores = L.exclude(_scores(spark, sf_dir), ["value_error"])
    out = L.strict_overall(L.task_scores(scores))
    return V.rounded(out, "provisional", "overall")


@query(
    sql(
        f"SELECT model, {r9('score', 'avg(accuracy)')}, "
        f"{r9('mean_latency_ms', 'sum(mean_latency_ms * total) / sum(total)')}, "
        "sum(total)::BIGINT AS items, 1 AS coverage, CAST(NULL AS DOUBLE) AS overall "
        "FROM dm WHERE task = 'choice' GROUP BY model"
    )
)
def single_task_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for runs with the choice task only."""
    predictions = V.keep_present(V.predict(V.items_choice(spark, sf_dir)))
    board = L.single_task_board(M.finalize(M.metric_cells(predictions)))
    return V.rounded(board, "score", "mean_latency_ms")


@query(
    sql(
        f"""
SELECT count(*) AS models, max_by(label, overall) AS best, {r9("best_overall", "max(overall)")},
       max_by(label, overall) FILTER (WHERE model IN ('m1', 'm2')) AS best_selected,
       min_by(label, latency) FILTER (WHERE model <> 'm0') AS fastest,
       {r9("fastest_latency", "min(latency) FILTER (WHERE model <> 'm0')")}
FROM (SELECT model, 'model ' || model AS label, overall, latency FROM board
      JOIN (SELECT model, sum(mean_latency_ms * total) / sum(total) AS latency FROM dm GROUP BY model)
      USING (model))"""
    )
)
def headline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model count, best overall, best among the selected, fastest local model."""
    metrics = V.quick_metrics(spark, sf_dir)
    tasks = L.task_scores(L.dataset_scores(V.configured(spark, sf_dir), metrics))
    latency = L.item_weighted_latency(metrics).select(
        "model", F.col("mean_latency_ms").alias("latency")
    )
    models = L.leaderboard(tasks, WEIGHTS, order=False).join(latency, "model").select(
        "model", F.concat(F.lit("model "), "model").alias("label"), "overall", "latency",
        F.when(F.col("model") == "m0", "service").otherwise("local").alias("family"),
    )
    out = L.headline(models, ["m1", "m2"], "service")
    return V.rounded(out, "best_overall", "fastest_latency")


@query(
    sql(
        f"SELECT row_number() OVER (ORDER BY coalesce(overall, 0) DESC, model) AS rank, model, "
        f"{r9('overall')} FROM board"
    )
)
def ranked_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaderboard with rank numbers."""
    out = L.ranked(_board(spark, sf_dir)).select(F.col("rank").cast("bigint").alias("rank"), "model", "overall")
    return V.rounded(out, "overall")


_AXES = ["value_click", "value_error", "value_purchase", "value_signup", "value_view"]


@query(
    sql(
        "SELECT model, "
        + ", ".join(
            f"round(max(normalized_quadratic_weighted_kappa) FILTER (WHERE dataset = '{a}'), 9) AS {a}"
            for a in _AXES
        )
        + " FROM dm WHERE task = 'score' GROUP BY model"
    )
)
def task_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models x fixed dataset list of one task."""
    metrics = V.quick_metrics(spark, sf_dir)
    out = X.task_matrix(metrics, "score", _AXES, "normalized_quadratic_weighted_kappa")
    return V.rounded(out, *_AXES)


@query(
    sql(
        f"""
SELECT model, axis, round(value, 9) AS value FROM (
  SELECT model, unnest(['noul', 'choice', 'score', 'overall']) AS axis,
         unnest([noul, choice, score, overall]) AS value FROM board WHERE available = 3)"""
    )
)
def summary_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task scores and overall of the models with every task available."""
    return V.rounded(X.summary_matrix(_board(spark, sf_dir)), "value")


@query(
    sql(
        "SELECT model AS series, "
        + ", ".join(
            f"round(max(accuracy) FILTER (WHERE dataset = '{a}'), 9) AS {a}" for a in ("prio_F", "prio_O")
        )
        + " FROM dm WHERE model NOT IN ('m3') GROUP BY model"
    )
)
def series_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent values on nested paths as one row per series and one column per axis."""
    metrics = V.quick_metrics(spark, sf_dir).filter(F.col("model") != "m3")
    nested = metrics.select(
        "model", "dataset", F.struct((F.col("accuracy") * 100).alias("accuracy")).alias("metrics")
    )
    out = X.series_matrix(
        nested, "model", ["prio_F", "prio_O"], metric="metrics.accuracy", scale="percent"
    )
    return V.rounded(out, "prio_F", "prio_O")


@query(
    sql(
        f"SELECT model, {r9('f1')}, {r9('recall')} FROM dm WHERE task = 'noul' AND dataset = 'quality'"
    )
)
def nested_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on nested paths of result rows."""
    metrics = V.quick_metrics(spark, sf_dir)
    nested = metrics.select(
        "model",
        F.struct(F.struct("task").alias("kind"), "dataset").alias("run"),
        F.struct("f1", "recall").alias("metrics"),
    )
    rows = W.match_nested(nested, {"run.kind.task": "noul", "run.dataset": "quality"})
    out = rows.select("model", "metrics.f1", "metrics.recall")
    return V.rounded(out, "f1", "recall")


@query(
    """
SELECT p_brand AS dataset, bool_or(avail) AS available,
       CASE WHEN bool_or(avail) THEN NULL ELSE 'source_not_found' END AS reason, count(*) AS parts
FROM (SELECT p_brand, p_size > 25 OR p_type IN (SELECT p_type FROM part WHERE p_partkey % 50 = 7) AS avail
      FROM part) GROUP BY p_brand"""
)
def available_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets whose source is staged or fetchable; the others with their reason."""
    part = V.table(spark, sf_dir, "part")
    datasets = part.select(
        F.col("p_brand").alias("dataset"), F.col("p_type").alias("path"),
        (F.col("p_size") > 25).alias("remote"),
    )
    staged = part.filter(F.col("p_partkey") % 50 == 7).select(F.col("p_type").alias("path"))
    found = W.availability(datasets, staged)
    return found.groupBy("dataset").agg(
        F.bool_or("available").alias("available"),
        F.when(~F.bool_or("available"), F.max("reason")).alias("reason"),
        F.count(F.lit(1)).alias("parts"),
    )


@query(
    """
SELECT 'selected' AS kind, p_name AS name, count(*) AS n FROM part
WHERE p_size % 5 <> 0 AND p_type = 'ECONOMY' AND p_name IN (SELECT p_name FROM part WHERE p_size = 7)
GROUP BY p_name
UNION ALL
SELECT 'unknown', 'Customer ' || c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment
UNION ALL
SELECT 'skipped', CASE WHEN s % 2 = 0 THEN 'source_not_found' ELSE 'gated' END, count(*) FROM
  (SELECT DISTINCT p_size AS s FROM part) GROUP BY ALL"""
)
def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled and selected rows, unknown selected ids, the merged skipped list."""
    part = V.table(spark, sf_dir, "part")
    config = part.select(
        F.col("p_name").alias("name"), (F.col("p_size") % 5 != 0).alias("enabled"),
        F.when(F.col("p_type") == "ECONOMY", "choice").otherwise("noul").alias("task"),
    )
    selection = part.filter(F.col("p_size") == 7).select(F.col("p_name").alias("name"))
    chosen = W.select_enabled(config, selection, "name", "choice")
    segments = V.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("Customer "), "c_mktsegment").alias("name")
    )
    unknown = W.unknown_ids(selection.unionByName(segments), config, "name")
    n = F.count(F.lit(1)).alias("n")
    sizes = part.select(F.col("p_size").alias("dataset")).distinct()
    first = sizes.filter(F.col("dataset") % 2 == 0).withColumn("reason", F.lit("source_not_found"))
    merged = W.extend_skipped(first, sizes.withColumn("reason", F.lit("gated")))
    per_segment = segments.join(unknown, "name", "left_semi")
    return (
        chosen.groupBy(F.lit("selected").alias("kind"), "name").agg(n)
        .unionByName(per_segment.groupBy(F.lit("unknown").alias("kind"), "name").agg(n))
        .unionByName(
            merged.groupBy(F.lit("skipped").alias("kind"), F.col("reason").alias("name")).agg(n)
        )
    )


@query(
    sql(
        f"""
SELECT model, dataset, task, source, {r9('accuracy')} FROM (
  SELECT model, dataset, task, 'first' AS source, accuracy FROM dm
  UNION ALL
  SELECT model, dataset, task, 'second', 0 FROM configured c WHERE NOT EXISTS
    (SELECT 1 FROM dm WHERE dm.model = c.model AND dm.dataset = c.dataset))"""
    )
)
def supplement_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets missing from a run taken from a second run, the first source winning."""
    columns = ("model", "dataset", "task")
    first = V.quick_metrics(spark, sf_dir).select(*columns, F.lit("first").alias("source"), "accuracy")
    second = V.configured(spark, sf_dir).select(
        *columns, F.lit("second").alias("source"), F.lit(0.0).alias("accuracy")
    )
    return V.rounded(L.supplement(first, second), "accuracy")


