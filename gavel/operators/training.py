"""Training small heads over frozen vectors, and cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.operators.metrics import finalize, metric_cells
from gavel.operators.ranking import kfold
from gavel.operators.scoring import linear_candidates, linear_yes_no
from gavel.session import local_table, materialize

# Metrics of one fold; row counts are left out of the summary.
FOLD_METRICS = {
    "choice": ("accuracy",),
    "noul": ("accuracy", "precision", "recall", "f1"),
    "score": (
        "accuracy", "mae", "rmse", "spearman", "quadratic_weighted_kappa",
        "normalized_quadratic_weighted_kappa",
    ),
}


@dataclass
class Fitted:
    """A linear head and its training history."""

    task: str
    weights: list[float]
    bias: float
    history: list[dict] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.task == "noul":
            return linear_yes_no(df, self.weights, self.bias)
        return linear_candidates(df, self.weights, self.bias)


class Trainer(Protocol):
    """Architecture plug-in: `fit(train, validation) -> model with transform`.

    One that also has `fit_folds(rows with fold, folds) -> models` fits all folds
    of a cross-validation together.
    """

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> Fitted: ...


# A run trains on the rows of all folds but its own and is validated on its own.
TRAIN, HELD = 1, 0


def _one_run(train: DataFrame, validation: DataFrame | None, *columns: str) -> DataFrame:
    """Training and validation rows as the folds of run HELD."""
    rows = train.select(*columns, F.lit(TRAIN).alias("fold"))
    if validation is None:
        return rows
    return rows.unionByName(validation.select(*columns, F.lit(HELD).alias("fold")))


def _added_up(
    data: DataFrame, sums: Callable[[pd.DataFrame], np.ndarray], shape: tuple[int, ...]
) -> np.ndarray:
    """`sums` of all batches, added up in the tasks and then by Spark: one job, one row a number.

    Integers stay exact as doubles up to 2 ** 53.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(int(np.prod(shape)))
        for frame in frames:
            if not frame.empty:
                total += sums(frame).ravel()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pos": at, "value": total[at]})

    rows = data.mapInPandas(run, "pos BIGINT, value DOUBLE").groupBy("pos")
    added = rows.agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(int(np.prod(shape)))
    out[added["pos"].to_numpy(int)] = added["value"].to_numpy()
    return out.reshape(shape)


def _counts(hits: np.ndarray, trains: np.ndarray) -> list[np.ndarray]:
    """Training hits and rows, validation hits and rows of every run; both inputs are rows x runs."""
    return [(hits & trains).sum(0), trains.sum(0), (hits & ~trains).sum(0), (~trains).sum(0)]


def _accuracies(counts: np.ndarray) -> dict[str, float | None]:
    hits, rows, held_hits, held = counts
    return {
        "train_accuracy": float(hits / rows) if rows else None,
        "val_accuracy": float(held_hits / held) if held else None,
    }


def _width(data: DataFrame, column: Column) -> int:
    first = data.select(F.size(column)).first()
    if first is None:
        raise ValueError("no training items")
    return first[0]


def _need_rows(rows: np.ndarray) -> None:
    if not rows.all():
        raise ValueError("no training items")


def _yes_no_sums(weights: np.ndarray, runs: Sequence[int], curved: bool) -> Callable:
    """Per run: counts, loss, gradient and (if `curved`) Hessian of the log loss; the bias comes last."""

    def sums(frame: pd.DataFrame) -> np.ndarray:
        x = np.stack(frame["embedding"].to_numpy()).astype(float)
        x = np.column_stack([x, np.ones(len(x))])
        y = frame["gold_index"].to_numpy()[:, None]
        trains = frame["fold"].to_numpy()[:, None] != np.array(runs)
        z = x @ weights.T
        p = np.exp(-np.logaddexp(0, -z))
        out = [*_counts((z >= 0) == (y == 1), trains), ((np.logaddexp(0, z) - y * z) * trains).sum(0)]
        out.append((((p - y) * trains).T @ x).T)
        if curved:
            spread = p * (1 - p) * trains
            out.append(np.stack([((x * spread[:, [k]]).T @ x).ravel() for k in range(len(runs))], axis=1))
        return np.vstack(out)

    return sums


class _Descent:
    """One run's way down: Newton steps, or L-BFGS where the Hessian is too large, halved while the loss rises."""

    MEMORY, HALVINGS = 10, 8

    def __init__(self, size: int, reg: float, epochs: int, tolerance: float):
        self.at, self.trial = np.zeros(size), np.zeros(size)
        self.penalty = np.append(np.full(size - 1, reg), 0.0)
        self.epochs, self.tolerance, self.history, self.done = epochs, tolerance, [], False
        self.loss, self.slope, self.step, self.scale = np.inf, None, None, 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def see(self, counts: np.ndarray, loss: float, slope: np.ndarray, hessian: np.ndarray | None) -> None:
        """Take the means at `trial` and choose the next one."""
        if self.done:
            return
        loss += 0.5 * float(self.penalty @ self.trial**2)
        slope = slope + self.penalty * self.trial
        if loss > self.loss + 1e-12 * max(1.0, abs(self.loss)):
            self.scale /= 2
            self.done = self.scale < 2.0**-self.HALVINGS
            if self.done:  # no way further down: the last step is not taken
                self.history.pop()
            self.trial = self.at - (0 if self.done else self.scale) * self.step
            return
        if self.step is not None:
            self.history[-1] |= _accuracies(counts)
            if float((self.trial - self.at) @ (slope - self.slope)) > 0:
                self.pairs = [*self.pairs, (self.trial - self.at, slope - self.slope)][-self.MEMORY :]
        self.at, self.loss, self.slope, self.scale = self.trial, loss, slope, 1.0
        if len(self.history) == self.epochs or np.abs(slope).max() < self.tolerance:
            self.done = True
            return
        self.history.append({"epoch": len(self.history) + 1, "mean_loss": loss})
        self.step = self._newton(slope, hessian) if hessian is not None else self._quasi_newton(slope)
        self.trial = self.at - self.step

    def _newton(self, slope: np.ndarray, hessian: np.ndarray) -> np.ndarray:
        hessian = hessian + np.diag(self.penalty)
        # A trace of ridge keeps separable data and unused components solvable.
        return np.linalg.solve(hessian + 1e-12 * (1 + np.trace(hessian)) * np.eye(len(slope)), slope)

    def _quasi_newton(self, slope: np.ndarray) -> np.ndarray:
        step, kept = slope.copy(), []
        for move, turn in reversed(self.pairs):
            share = (move @ step) / (move @ turn)
            kept.append(share)
            step -= share * turn
        if self.pairs:
            move, turn = self.pairs[-1]
            step *= (move @ turn) / (turn @ turn)
        for (move, turn), share in zip(self.pairs, reversed(kept)):
            step += move * (share - (turn @ step) / (move @ turn))
        return step


@dataclass
class YesNoHead:
    """Binary logistic head on `embedding`: mean log loss and an L2 penalty on the weights, not the bias.

    Newton's method: one job a step returns the summed gradient, Hessian, loss
    and hits of all runs. Beyond `newton_size` components the Hessian of size
    squared is left out and the steps are L-BFGS steps from the same gradients.
    A step that raises the loss is halved. An epoch's row has the loss before its
    step and the accuracies after it; a run that has converged has no more rows.
    """

    epochs: int = 20
    reg: float = 0.0
    newton_size: int = 512
    tolerance: float = 1e-10  # of the gradient's largest component

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> Fitted:
        return self.fit_folds(_one_run(train, validation, "embedding", "gold_index"), [HELD])[0]

    def fit_folds(self, tagged: DataFrame, runs: Sequence[int]) -> list[Fitted]:
        """One head a run over rows with `fold`; a step of all runs is one job."""
        data = tagged.select("embedding", "gold_index", "fold").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(data, runs)
        finally:
            data.unpersist()

    def _fit(self, data: DataFrame, runs: Sequence[int]) -> list[Fitted]:
        size = _width(data, F.col("embedding")) + 1
        curved = size <= self.newton_size
        shape = (5 + size + (size * size if curved else 0), len(runs))
        ways = [_Descent(size, self.reg, self.epochs, self.tolerance) for _ in runs]
        while not all(way.done for way in ways):
            weights = np.stack([way.trial for way in ways])
            total = _added_up(data, _yes_no_sums(weights, runs, curved), shape)
            _need_rows(total[1])
            for way, sums in zip(ways, total.T):
                means = sums[4:] / sums[1]
                hessian = means[1 + size :].reshape(size, size) if curved else None
                way.see(sums[:4], float(means[0]), means[1 : 1 + size], hessian)
        return [Fitted("noul", way.at[:-1].tolist(), float(way.at[-1]), way.history) for way in ways]


def _candidate_sums(weights: np.ndarray, runs: Sequence[int]) -> Callable:
    """Per run: counts, loss and gradient of softmax cross-entropy over an item's candidates."""

    def sums(frame: pd.DataFrame) -> np.ndarray:
        # All candidates of the batch as one matrix, an item's rows together.
        sizes = frame["candidates"].map(len).to_numpy()
        starts = np.cumsum(sizes) - sizes
        x = np.stack([v for row in frame["candidates"] for v in row]).astype(float)
        logits = x @ weights.T
        high = np.maximum.reduceat(logits, starts)
        p = np.exp(logits - np.repeat(high, sizes, axis=0))
        p /= np.repeat(np.add.reduceat(p, starts), sizes, axis=0)
        gold = starts + frame["gold_index"].to_numpy()
        trains = frame["fold"].to_numpy()[:, None] != np.array(runs)
        # The first of equal candidates is the prediction.
        place = np.where(logits == np.repeat(high, sizes, axis=0), np.arange(len(x))[:, None], len(x))
        hits = np.minimum.reduceat(place, starts) == gold[:, None]
        loss = (-np.log(np.maximum(p[gold], 1e-12)) * trains).sum(0)
        p[gold] -= 1.0
        return np.vstack([*_counts(hits, trains), loss, ((p * np.repeat(trains, sizes, axis=0)).T @ x).T])

    return sums


@dataclass
class CandidateHead:
    """One weight vector shared by an item's candidates, softmax cross-entropy.

    Full-batch Adam: each epoch is one Spark job for all runs, whose tasks return
    a sum per weight and run; Spark adds those up. An epoch's row has the loss
    before its step and the accuracies after it.
    """

    epochs: int = 5
    lr: float = 0.05
    track: bool = True

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> Fitted:
        return self.fit_folds(_one_run(train, validation, "candidates", "gold_index"), [HELD])[0]

    def fit_folds(self, tagged: DataFrame, runs: Sequence[int]) -> list[Fitted]:
        """One head a run over rows with `fold`; an epoch of all runs is one job."""
        data = tagged.select("candidates", "gold_index", "fold").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(data, runs)
        finally:
            data.unpersist()

    def _fit(self, data: DataFrame, runs: Sequence[int]) -> list[Fitted]:
        size = _width(data, F.get("candidates", F.lit(0)))
        weights, moment, square = (np.zeros((len(runs), size)) for _ in range(3))
        history: list[list[dict]] = [[] for _ in runs]
        # With `track` one pass more than epochs: each also counts the hits of the step before it.
        for epoch in range(1, self.epochs + 1 + self.track):
            total = _added_up(data, _candidate_sums(weights, runs), (5 + size, len(runs)))
            _need_rows(total[1])
            for rows, counts in zip(history, total[:4].T):
                if self.track and rows:
                    rows[-1] |= _accuracies(counts)
            if epoch > self.epochs:
                break
            gradient = (total[5:] / total[1]).T
            moment = 0.9 * moment + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            step = (moment / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
            weights = weights - self.lr * step
            for rows, loss in zip(history, total[4] / total[1]):
                rows.append({"epoch": epoch, "mean_loss": float(loss)})
        return [Fitted("choice", own.tolist(), 0.0, rows) for own, rows in zip(weights, history)]


TRAINERS: dict[str, Callable[..., Trainer]] = {
    "yes_no_head": YesNoHead,
    "candidate_head": CandidateHead,
}


def get_trainer(name: str, **options) -> Trainer:
    if name not in TRAINERS:
        raise KeyError(f"unknown architecture: {name}")
    return TRAINERS[name](**options)


def history_frame(spark, model: Fitted) -> DataFrame:
    """Per-epoch history as a table."""
    rows = [
        (h["epoch"], h["mean_loss"], h.get("train_accuracy"), h.get("val_accuracy"))
        for h in model.history
    ]
    return local_table(
        spark,
        rows,
        "epoch INT, mean_loss DOUBLE, train_accuracy DOUBLE, val_accuracy DOUBLE",
    )


def fold_metrics(predictions: DataFrame, keys: Sequence[str], task: str = "task") -> DataFrame:
    """Metric set per fold; `keys` include fold and task."""
    needed = {
        "probabilities": F.lit(None).cast("array<double>"),
        "latency_ms": F.lit(0.0),
        "score_metadata": F.lit(None).cast(
            "struct<usage: struct<input_tokens: bigint, output_tokens: bigint>>"
        ),
    }
    df = predictions.withColumns(
        {c: v for c, v in needed.items() if c not in predictions.columns}
    )
    return finalize(metric_cells(df, keys), keys, task)


def cv_summary(
    metrics: DataFrame, keys: Sequence[str] = ("task",), fold: str = "fold"
) -> DataFrame:
    """Mean, population std and the per-fold values of every metric, long form."""
    names = sorted({m for group in FOLD_METRICS.values() for m in group})
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    )
    long = metrics.select(*keys, fold, F.inline(pairs)).filter(F.col("value").isNotNull())
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(fold, "value"))), lambda s: s["value"]
        ).alias("values"),
    )


def cross_validate(
    items: DataFrame,
    trainer: Callable[[], Trainer],
    folds: int = 5,
    id_column: str = "id",
    seed: int = 42,
) -> tuple[list[Fitted], DataFrame | None]:
    """A model per fold and the fold-wise summary.

    `folds=1` trains one model on everything and returns no summary. The heads of
    all folds learn together: each epoch is one job over the rows, whatever the
    number of folds. All validation predictions are scored in one aggregation.
    """
    if folds == 1:
        return [trainer().fit(items)], None
    # Written once to the shared folder: every epoch reads it.
    tagged = materialize(kfold(items, folds, id_column=id_column, seed=seed), "folds")
    runs, made = range(folds), trainer()
    if hasattr(made, "fit_folds"):
        models = made.fit_folds(tagged, runs)
    else:
        models = [trainer().fit(tagged.filter(F.col("fold") != k)) for k in runs]
    predictions = None
    for k, model in enumerate(models):
        own = model.transform(tagged.filter(F.col("fold") == k)).select("task", "fold", "gold_index", "predicted_index")
        predictions = own if predictions is None else predictions.unionByName(own)
    return models, cv_summary(fold_metrics(predictions, ["task", "fold"]))
