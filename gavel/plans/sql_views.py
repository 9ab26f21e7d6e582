"""The views of `gavel.plans.views` as SQL common table expressions."""

from __future__ import annotations

from gavel.functions.text import WHITESPACE
from gavel.plans.registry import with_views
from gavel.plans.views import (
    EVENT_PROMPT,
    EVENT_THRESHOLDS,
    MISSING,
    MODELS,
    PRIORITIES,
    TASK_METRIC,
)

NL = "chr(10)"


def strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


def texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def byte(hexed: str, i: str) -> str:
    """Byte `i` of a hex digest."""
    return f"CAST('0x' || substr({hexed}, 2 * ({i}) + 1, 2) AS INT)"


def r9(name: str, expression: str | None = None) -> str:
    return f"round(CAST({expression or name} AS DOUBLE), 9) AS {name}"


_YES_NO = """
SELECT '{label}' AS dataset, 'noul' AS task, '{label}:' || d.doc_id AS id,
       {question} AS question, {options} AS options, l.{label} AS gold_index
FROM documents d JOIN labels l USING (doc_id)"""


def _yes_no(label: str, lead: str) -> str:
    return _YES_NO.format(
        label=label,
        question=strip(f"'{lead}' || {NL} || '文章: ' || d.text"),
        options=texts(["いいえ", "はい"]),
    )


_missing = " OR ".join(f"(model = '{m}' AND dataset = '{d}')" for m, d in MISSING)
_levels = " + ".join(f"(value >= {t})::INT" for t in EVENT_THRESHOLDS)
_metric = " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in TASK_METRIC.items())

VIEWS = {
    "items_noul": _yes_no("toxic", "次の文章は有害ですか？"),
    "items_quality": _yes_no("quality", "次の文章は高品質ですか？"),
    "items_score": f"""
SELECT 'value_' || event_type AS dataset, 'score' AS task,
       'value:' || event_id || ':' || event_type AS id,
       '{EVENT_PROMPT}' || {NL} || '状態: ' || event_type || ' '
         || CAST(round(value * 100) AS BIGINT) AS question,
       {texts(["L0", "L1", "L2", "L3", "L4"])} AS options,
       {_levels} AS gold_index
FROM events""",
    "items_choice": f"""
SELECT 'prio_' || o_orderstatus AS dataset, 'choice' AS task,
       'prio_' || o_orderstatus || ':' || o_orderkey AS id,
       'order ' || o_orderkey || ' of customer ' || o_custkey AS question,
       {texts(PRIORITIES)} AS options,
       CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS gold_index
FROM orders""",
    "items": """
SELECT * FROM items_noul UNION ALL SELECT * FROM items_quality
UNION ALL SELECT * FROM items_score UNION ALL SELECT * FROM items_choice""",
    "models": f"SELECT unnest({texts(MODELS)}) AS model",
    "hashed": "SELECT model, i.*, sha256(model || ':' || question) AS h FROM items i, models",
    "scored": f"""
SELECT *, list_transform(range(len(options)), lambda i: {byte("h", "i")} + 1.0::DOUBLE) AS scores
FROM hashed""",
    "preds": f"""
SELECT model, dataset, task, id, question, options, gold_index, scores,
       list_transform(scores, lambda s: s / list_sum(scores)) AS probabilities,
       list_position(scores, list_max(scores)) - 1 AS predicted_index,
       {byte("h", "31")} / 10.0::DOUBLE AS latency_ms,
       length(question) AS input_tokens, 1 AS output_tokens
FROM scored""",
    "present": f"SELECT * FROM preds WHERE NOT ({_missing})",
    # Metrics, written from the definitions rather than from mergeable sums.
    "basic": """
SELECT model, dataset, task, count(*) AS total,
       count(*) FILTER (WHERE predicted_index = gold_index) AS correct,
       avg(latency_ms) AS mean_latency_ms, sum(latency_ms) AS sum_latency_ms,
       quantile_cont(latency_ms, 0.5) AS p50_latency_ms,
       quantile_cont(latency_ms, 0.95) AS p95_latency_ms,
       sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
       -avg(ln(greatest(probabilities[gold_index + 1], 1e-12))) AS nll,
       avg(list_sum(list_transform(probabilities,
           lambda v, i: (v - (i = gold_index + 1)::INT) * (v - (i = gold_index + 1)::INT))))
           AS brier_score,
       count(*) FILTER (WHERE predicted_index = 1 AND gold_index = 1) AS tp,
       count(*) FILTER (WHERE predicted_index = 1 AND gold_index = 0) AS fp,
       count(*) FILTER (WHERE predicted_index = 0 AND gold_index = 1) AS fn,
       avg(abs(predicted_index - gold_index)) AS mae,
       sqrt(avg((predicted_index - gold_index) * (predicted_index - gold_index))) AS rmse,
       max(greatest(predicted_index, gold_index)) AS top
FROM present GROUP BY ALL""",
    "bins": """
SELECT model, dataset, task,
       least(CAST(floor(list_max(probabilities) * 10) AS INT), 9) AS bin,
       count(*) AS n, avg((predicted_index = gold_index)::INT) AS acc,
       avg(list_max(probabilities)) AS conf
FROM present GROUP BY ALL""",
    "eces": """
SELECT model, dataset, task, sum(n * abs(acc - conf)) / sum(n) AS ece FROM bins GROUP BY ALL""",
    "cells": """
SELECT model, dataset, task, gold_index AS g, predicted_index AS p, count(*) AS n
FROM present GROUP BY ALL""",
    "golds": "SELECT model, dataset, task, g, sum(n) AS n FROM cells GROUP BY ALL",
    "guesses": "SELECT model, dataset, task, p, sum(n) AS n FROM cells GROUP BY ALL",
    "kappas": """
SELECT o.model, o.dataset, o.task, 1 - o.err * o.n / e.err AS kappa FROM
  (SELECT model, dataset, task, sum(n * (g - p) * (g - p))::DOUBLE AS err,
          sum(n)::DOUBLE AS n FROM cells GROUP BY ALL) o
  JOIN (SELECT a.model, a.dataset, a.task,
               sum(a.n * b.n * (a.g - b.p) * (a.g - b.p))::DOUBLE AS err
        FROM golds a JOIN guesses b USING (model, dataset, task) GROUP BY ALL) e
  USING (model, dataset, task)""",
    "ranks": """
SELECT model, dataset, task,
       rank() OVER (PARTITION BY model, dataset ORDER BY gold_index)
         + (count(*) OVER (PARTITION BY model, dataset, gold_index) - 1) / 2.0 AS rg,
       rank() OVER (PARTITION BY model, dataset ORDER BY predicted_index)
         + (count(*) OVER (PARTITION BY model, dataset, predicted_index) - 1) / 2.0 AS rp
FROM present WHERE task = 'score'""",
    "spearmans": """
SELECT model, dataset, task, coalesce(corr(rg, rp), 0) AS spearman FROM ranks GROUP BY ALL""",
    "dm": """
SELECT b.model, b.dataset, b.task, correct / total AS accuracy, correct, total,
       mean_latency_ms, sum_latency_ms, p50_latency_ms, p95_latency_ms,
       total / (sum_latency_ms / 1000) AS throughput_items_per_second,
       input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens,
       (input_tokens + output_tokens) / total AS mean_tokens_per_item,
       nll, brier_score, ece,
       CASE WHEN b.task = 'noul' THEN coalesce(tp / nullif(tp + fp, 0), 0) END AS precision,
       CASE WHEN b.task = 'noul' THEN coalesce(tp / nullif(tp + fn, 0), 0) END AS recall,
       CASE WHEN b.task = 'noul' THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) END AS f1,
       CASE WHEN b.task = 'score' THEN mae END AS mae,
       CASE WHEN b.task = 'score' THEN rmse END AS rmse,
       CASE WHEN b.task = 'score' THEN spearman END AS spearman,
       CASE WHEN b.task = 'score' THEN kappa END AS quadratic_weighted_kappa,
       CASE WHEN b.task = 'score' THEN least(greatest((kappa + 1) / 2, 0), 1) END
         AS normalized_quadratic_weighted_kappa
FROM basic b JOIN eces USING (model, dataset, task)
LEFT JOIN kappas USING (model, dataset, task)
LEFT JOIN spearmans USING (model, dataset, task)""",
    "configured": f"""
SELECT model, task, dataset, CASE task {_metric} END AS metric
FROM (SELECT DISTINCT task, dataset FROM items), models""",
    "scores": """
SELECT c.model, c.task, c.dataset, c.metric, m.total,
       CASE c.metric WHEN 'f1' THEN m.f1 WHEN 'accuracy' THEN m.accuracy
            ELSE m.normalized_quadratic_weighted_kappa END AS value
FROM configured c LEFT JOIN dm m USING (model, task, dataset)""",
    "tasks": """
SELECT model, task, avg(value) AS score, count(value) AS completed, count(*) AS configured,
       CASE WHEN count(value) = 0 THEN 'unavailable'
            WHEN count(value) = count(*) THEN 'complete' ELSE 'partial' END AS status
FROM scores GROUP BY ALL""",
    "wide": """
SELECT model, max(score) FILTER (WHERE task = 'noul') AS noul,
       max(score) FILTER (WHERE task = 'choice') AS choice,
       max(score) FILTER (WHERE task = 'score') AS score,
       count(score) AS available, min((status = 'complete')::INT) AS all_complete,
       max(status) FILTER (WHERE task = 'noul') AS noul_status,
       max(status) FILTER (WHERE task = 'choice') AS choice_status,
       max(status) FILTER (WHERE task = 'score') AS score_status
FROM tasks GROUP BY ALL""",
    "board": """
SELECT model, noul, choice, score, noul_status, choice_status, score_status, available,
       (coalesce(noul * 2, 0) + coalesce(choice, 0) + coalesce(score, 0))
         / ((noul IS NOT NULL)::INT * 2 + (choice IS NOT NULL)::INT + (score IS NOT NULL)::INT)
         AS overall,
       CASE WHEN all_complete = 1 THEN 'complete' ELSE 'partial' END AS overall_status,
       available || '/3' AS coverage
FROM wide WHERE available > 0""",
}


def sql(final: str, **extra: str) -> str:
    """A SELECT over the views, with additional local views."""
    return with_views(final, {**VIEWS, **extra})
