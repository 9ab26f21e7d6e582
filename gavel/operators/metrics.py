"""Dataset metrics as mergeable sums.

Predictions are first combined map-side into small cells, one per
(keys, gold, predicted, confidence bin). Every metric follows from the cells,
so a huge group never travels row by row and new predictions merge by addition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.arrays import FLOOR
from gavel.operators import percentiles as P
from gavel.schemas import TASKS, require

ECE_BINS = 10  # fixed value: equal-width confidence bins
KEYS = ("model", "dataset", "task")
ORDINAL_DEFAULTS = {  # fixed values: ordinal metrics of an empty dataset
    "mae": 0.0,
    "rmse": 0.0,
    "spearman": 0.0,
    "quadratic_weighted_kappa": 0.0,
    "normalized_quadratic_weighted_kappa": 0.5,
}
CELL_SUMS = (
    "n", "n_prob", "n_usage", "sum_ll", "sum_brier", "sum_gap", "sum_latency",
    "sum_input", "sum_output",
)


def ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Quotient with a constant for a zero denominator."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(default))


def metric_cells(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Predictions -> mergeable sums per (keys, gold, predicted, confidence bin).

    brier = sum_i (p_i - [i = gold])^2 = sum_i p_i^2 - 2 p_gold + 1.
    """
    facts = predictions.selectExpr(
        *keys,
        "gold_index AS gold",
        "predicted_index AS predicted",
        "latency_ms",
        "score_metadata.usage AS usage",
        "array_max(probabilities) AS confidence",
        "array_position(probabilities, array_max(probabilities)) - 1 = gold_index AS hit",
        "get(probabilities, gold_index) AS p_gold",
        "aggregate(probabilities, 0D, (total, v) -> total + v * v) AS squares",
    )
    rows = facts.withColumn(
        "bin", F.expr(f"least(int(confidence * {ECE_BINS}), {ECE_BINS - 1})")
    )
    sums = {
        "n": "count(1)",
        "n_prob": "count(confidence)",
        "n_usage": "count(usage)",
        "sum_ll": f"sum(ln(greatest(p_gold, {FLOOR}D)))",
        "sum_brier": "sum(squares - 2 * p_gold + 1)",
        "sum_gap": "sum(double(hit) - confidence)",
        "sum_latency": "sum(latency_ms)",
        "sum_input": "sum(coalesce(usage.input_tokens, 0))",
        "sum_output": "sum(coalesce(usage.output_tokens, 0))",
    }
    return rows.groupBy(*keys, "gold", "predicted", "bin").agg(
        *[F.expr(f"{body} AS {name}") for name, body in sums.items()]
    )


def merge_cells(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add up cells of several batches."""
    return cells.groupBy(*keys, "gold", "predicted", "bin").agg(
        *[F.sum(c).alias(c) for c in CELL_SUMS]
    )


def _with_ranks(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-averaged ranks of both marginals, centred on their known mean (n + 1) / 2."""
    part = "PARTITION BY " + ", ".join(f"`{k}`" for k in keys)

    def rank(name: str) -> str:
        upto = f"sum(n) OVER ({part} ORDER BY {name})"
        same = f"sum(n) OVER ({part}, {name})"
        return f"{upto} - {same} + ({same} + 1) / 2 - (sum(n) OVER ({part}) + 1) / 2 AS r_{name}"

    return cells.selectExpr("*", rank("gold"), rank("predicted"))


# Sums over the cells of one key; `d` is predicted - gold.
_TOTALS = {
    "total": "sum(n)",
    "correct": "sum(if(gold = predicted, n, 0))",
    "tp": "sum(if(predicted = 1 AND gold = 1, n, 0))",
    "fp": "sum(if(predicted = 1 AND gold = 0, n, 0))",
    "fn": "sum(if(predicted = 0 AND gold = 1, n, 0))",
    "low": "min(least(gold, predicted))",
    "high": "max(greatest(gold, predicted))",
    "abs_error": "sum(n * abs(bigint(predicted - gold)))",
    "square_error": "sum(n * bigint((predicted - gold) * (predicted - gold)))",
    "s_p": "double(sum(n * bigint(predicted)))",
    "s_g": "double(sum(n * bigint(gold)))",
    "s_pp": "double(sum(n * bigint(predicted * predicted)))",
    "s_gg": "double(sum(n * bigint(gold * gold)))",
    "r_gp": "sum(n * r_gold * r_predicted)",
    "r_gg": "sum(n * r_gold * r_gold)",
    "r_pp": "sum(n * r_predicted * r_predicted)",
    "n_prob": "sum(n_prob)",
    "n_usage": "sum(n_usage)",
    "ll": "sum(sum_ll)",
    "brier": "sum(sum_brier)",
    "latency": "sum(sum_latency)",
    "inputs": "sum(sum_input)",
    "outputs": "sum(sum_output)",
    **{f"gap{b}": f"abs(coalesce(sum(if(bin = {b}, sum_gap, 0D)), 0D))" for b in range(ECE_BINS)},
}
_GAPS = " + ".join(f"gap{b}" for b in range(ECE_BINS))
# Quadratic weighted kappa from moments: 1 - n S(p-g)^2 / (n Sp^2 + n Sg^2 - 2 Sp Sg).
_KAPPA = (
    "if(high < 1, 1D, coalesce(1 - try_divide(double(total) * square_error, "
    "double(total) * s_pp + double(total) * s_gg - 2 * s_p * s_g), 1D))"
)
_DERIVED = {
    "p_": "coalesce(try_divide(tp, tp + fp), 0D)",
    "r_": "coalesce(try_divide(tp, tp + fn), 0D)",
    "k_": _KAPPA,
    "c_": "n_prob = total",
    "u_": "n_usage > 0",
}


def _final(task: str) -> dict[str, str]:
    noul, score = f"`{task}` = 'noul'", f"`{task}` = 'score'"
    return {
        "accuracy": "coalesce(try_divide(correct, total), 0D)",
        "correct": "correct",
        "total": "total",
        "mean_latency_ms": "latency / total",
        "sum_latency_ms": "latency",
        "input_tokens": "if(u_, inputs, NULL)",
        "output_tokens": "if(u_, outputs, NULL)",
        "total_tokens": "if(u_, inputs + outputs, NULL)",
        "mean_tokens_per_item": "if(u_, (inputs + outputs) / total, NULL)",
        "nll": "if(c_, -ll / total, NULL)",
        "brier_score": "if(c_, brier / total, NULL)",
        "ece": f"if(c_, ({_GAPS}) / total, NULL)",
        "precision": f"if({noul}, p_, NULL)",
        "recall": f"if({noul}, r_, NULL)",
        "f1": f"if({noul}, coalesce(try_divide(2 * p_ * r_, p_ + r_), 0D), NULL)",
        "mae": f"if({score}, abs_error / total, NULL)",
        "rmse": f"if({score}, sqrt(square_error / total), NULL)",
        "spearman": f"if({score}, coalesce(try_divide(r_gp, sqrt(r_gg * r_pp)), 0D), NULL)",
        "quadratic_weighted_kappa": f"if({score}, k_, NULL)",
        "normalized_quadratic_weighted_kappa": (
            f"if({score}, least(greatest((k_ + 1) / 2, 0D), 1D), NULL)"
        ),
    }


def finalize(cells: DataFrame, keys: Sequence[str] = KEYS, task: str = "task") -> DataFrame:
    """Cells -> one row of metrics per key; metrics that do not apply are NULL."""
    sums = _with_ranks(cells, keys).groupBy(*keys).agg(
        *[F.expr(f"{body} AS {name}") for name, body in _TOTALS.items()]
    )
    t = F.col(task)
    sums = require(sums, t.isin(*TASKS), F.concat(F.lit("unsupported task_type: "), t))
    sums = require(
        sums,
        (t != "noul") | ((F.col("low") >= 0) & (F.col("high") <= 1)),
        "noul evaluation requires binary indices",
    )
    derived = sums.selectExpr("*", *[f"{body} AS {name}" for name, body in _DERIVED.items()])
    return derived.selectExpr(
        *[f"`{k}`" for k in keys], *[f"{body} AS {name}" for name, body in _final(task).items()]
    )


def normalized_kappa(kappa: Column) -> Column:
    return F.least(F.greatest((kappa + 1) / 2, F.lit(0.0)), F.lit(1.0))


LATENCY_FRACTIONS = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}


def latency_profile(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact p50 / p95 latency per key."""
    return P.percentiles(P.value_cells(predictions, keys), keys, LATENCY_FRACTIONS)


def approximate_latency(
    predictions: DataFrame, keys: Sequence[str] = KEYS, accuracy: int = 10000
) -> DataFrame:
    """p50 / p95 from a bounded sketch: one pass, relative rank error 1 / accuracy."""
    return predictions.groupBy(*keys).agg(
        *[
            F.percentile_approx("latency_ms", f, accuracy).alias(name)
            for name, f in LATENCY_FRACTIONS.items()
        ]
    )


def throughput(metrics: DataFrame, elapsed_seconds: Column) -> DataFrame:
    """Items per second; 0 when nothing elapsed."""
    return metrics.withColumn(
        "throughput_items_per_second", ratio(F.col("total"), elapsed_seconds)
    )


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two small per-key tables, NULL keys included.

    Null-safe also because a plain join would push a NULL filter into one of the
    two reads of a shared shuffle and so prevent its reuse.
    """
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(named, on, "left").drop(*[f"__{k}" for k in keys])


def summarize(
    predictions: DataFrame,
    keys: Sequence[str] = KEYS,
    elapsed: DataFrame | None = None,
    task: str = "task",
) -> DataFrame:
    """Every metric of every key.

    `elapsed` (keys, elapsed_seconds) comes from run metadata; without it the
    summed latency stands in.
    """
    base = finalize(metric_cells(predictions, keys), keys, task)
    wide = attach(base, latency_profile(predictions, keys), keys)
    if elapsed is None:
        return throughput(wide, F.col("sum_latency_ms") / 1000)
    joined = throughput(attach(wide, elapsed, keys), F.col("elapsed_seconds"))
    return joined.drop("elapsed_seconds")


def with_empty_groups(configured: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Configured groups without a single row get the metrics of an empty set."""
    joined = configured.join(metrics, list(keys), "left")
    zeros = {c: 0.0 for c in ("accuracy", "mean_latency_ms", "p50_latency_ms", "p95_latency_ms",
                              "throughput_items_per_second")}
    out = joined.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v))
            for c, v in {**zeros, "total": 0, "correct": 0}.items()
            if c in joined.columns
        }
    )
    empty = F.col("total") == 0
    by_task = {"score": ORDINAL_DEFAULTS, "noul": {"precision": 0.0, "recall": 0.0, "f1": 0.0}}
    for task, defaults in by_task.items():
        out = out.withColumns(
            {
                c: F.when(empty & (F.col("task") == task), F.lit(v)).otherwise(F.col(c))
                for c, v in defaults.items()
                if c in out.columns
            }
        )
    return out


def confusion(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Confusion matrix in long form with both marginals."""
    cells = predictions.groupBy(*keys, "gold_index", "predicted_index").agg(
        F.count(F.lit(1)).alias("n")
    )
    return cells.withColumns(
        {
            "gold_total": F.sum("n").over(Window.partitionBy(*keys, "gold_index")),
            "predicted_total": F.sum("n").over(Window.partitionBy(*keys, "predicted_index")),
        }
    )


def confusion_wide(
    predictions: DataFrame, size: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Confusion matrix with one column per predicted index."""
    counts = (
        predictions.groupBy(*keys, "gold_index")
        .pivot("predicted_index", list(range(size)))
        .agg(F.count(F.lit(1)))
    )
    return counts.select(
        *keys,
        "gold_index",
        *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"p{i}") for i in range(size)],
    )


def api_cost(metrics: DataFrame, rate_per_million: float) -> DataFrame:
    """Cost estimate from input tokens."""
    return metrics.withColumn(
        "estimated_cost", F.col("input_tokens") / 1_000_000 * rate_per_million
    )
