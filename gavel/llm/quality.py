"""Document quality by a linear-chain conditional random field over lines.

Every line that is not blank is labelled good or bad. Its features are the shares
of kinds of characters, its length, its words and their repetition, and the same
of the line before and after it. The chain adds a score for each pair of labels
of neighbouring lines. Forward-backward gives every line's probability of being
good; the document's quality is their mean, weighted by the lines' lengths.

Lines are not labelled themselves: each line of a sampled document carries the
document's label. Learning uses at most PER_CLASS documents a label outside the
held-out fold, a bounded sample; every document is scored over its whole text.

Defined cases: a null, empty or blank text has score 0; without labelled rows of
both kinds every score is 0; a null id is in the fold of the empty text; repeated
rows are scored alike; an empty table gives an empty result; extra columns stay
(`without_poor`) or are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.labelled import in_fold, predicted, sample
from gavel.llm.rows import packed, text_of, unpacked

FOLD = (4, 2)  # ids that teach nothing: modulus and remainder
PER_CLASS = 2000  # sampled documents of each label at most
STEPS, RATE, DECAY = 100, 0.1, 1e-4
KINDS = 9  # kinds of bytes below
SLICE = 1 << 20  # bytes that are counted in one go
GROUP = 256  # documents that are scored in one go


def _kinds() -> np.ndarray:
    kind = np.full(256, 7, np.int64)  # other signs
    for number, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", ".,;:?'\"-()", "!", "|/\\[]{}<>")):
        kind[list(chars.encode())] = number
    kind[128:] = 8
    return kind


KIND = _kinds()


@dataclass
class Lines:
    """Features of the lines of some texts, one after another."""

    features: np.ndarray
    weights: np.ndarray  # bytes
    starts: np.ndarray  # of each text
    sizes: np.ndarray  # lines of each text


def _byte_counts(blob: bytes, ends: np.ndarray) -> np.ndarray:
    """Bytes of each kind in each line; `ends` are the places behind the lines."""
    data, counts = np.frombuffer(blob, np.uint8), np.zeros((len(ends), KINDS))
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        first = np.searchsorted(ends, at, "right")
        last = np.searchsorted(ends, at + len(part) - 1, "right") + 1
        inner = np.clip(ends[first:last], at, at + len(part)) - at
        line = np.repeat(np.arange(len(inner)), np.diff(inner, prepend=0))
        sums = np.bincount(line * KINDS + KIND[part[: len(line)]], minlength=len(inner) * KINDS)
        counts[first:last] += sums.reshape(-1, KINDS)
    return counts


def line_features(texts: Sequence[bytes | None]) -> Lines:
    """Features of all lines that are not blank; texts are UTF-8."""
    lines, sizes, words, distinct, repeats, same = [], [], [], [], [], []
    for text in texts:
        before, count = None, 0
        for line in (text or b"").split(b"\n"):
            own = line.split()
            if not own:
                continue
            count += 1
            lines.append(line)
            words.append(len(own))
            distinct.append(len(set(own)))
            repeats.append(sum(map(eq, own, islice(own, 1, None))))
            same.append(line == before)
            before = line
        sizes.append(count)
    sizes, words = np.array(sizes, np.int64), np.array(words, float)
    starts = np.cumsum(sizes) - sizes
    weights = np.fromiter(map(len, lines), np.int64, len(lines))
    if not lines:
        return Lines(np.zeros((0, 3 * (KINDS + 6) + 3)), weights.astype(float), starts, sizes)
    shares = _byte_counts(b"".join(lines), np.cumsum(weights)) / weights[:, None]
    own = np.column_stack([
        shares, np.log1p(weights), np.log1p(words), weights / words / 10, np.array(distinct) / words,
        np.array(repeats) / words, np.log(words) * (1 - np.array(distinct) / words),
    ])
    first, last = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    first[starts[sizes > 0]] = True
    last[(starts + sizes - 1)[sizes > 0]] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = own[first], own[last]
    return Lines(np.column_stack([own, before, after, first, last, same]), weights.astype(float), starts, sizes)


def forward_backward(good: np.ndarray, pair: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Log messages (forward, backward) of every line and log partition of every text.

    `good` is a line's score of being good (bad has 0), `pair[i, j]` that of label
    j behind label i. All texts move one line a step, the longest first.
    """
    unary = np.column_stack([np.zeros(len(good)), good])
    forward, backward = unary.copy(), np.zeros((len(good), 2))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # texts with more than t lines
    for t in range(1, longest):
        at = starts[: alive[t]] + t
        a = forward[at - 1]
        forward[at] += np.logaddexp(a[:, :1] + pair[0], a[:, 1:] + pair[1])
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        b = unary[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(pair[:, 0] + b[:, :1], pair[:, 1] + b[:, 1:])
    logz = np.zeros(len(sizes))
    ends = (starts + sizes - 1)[: alive[0] if longest else 0]
    logz[order[: len(ends)]] = np.logaddexp(forward[ends, 0], forward[ends, 1])
    return forward, backward, logz


@dataclass
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # of each feature, the last for none
    pair: np.ndarray

    def unary(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale @ self.weight[:-1] + self.weight[-1]

    def line_marginals(self, lines: Lines) -> np.ndarray:
        """Probability of every line to be good."""
        forward, backward, _ = forward_backward(self.unary(lines.features), self.pair, lines.starts, lines.sizes)
        both = forward + backward
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))

    def scores(self, texts: Sequence[bytes | None]) -> np.ndarray:
        lines = line_features(texts)
        text = np.repeat(np.arange(len(texts)), lines.sizes)
        good = np.bincount(text, self.line_marginals(lines) * lines.weights, len(texts))
        return np.clip(good / np.maximum(np.bincount(text, lines.weights, len(texts)), 1), 0, 1)


def train(rows: list[tuple[str, int]]) -> LineField | None:
    """Fit the field to (text, label); None without both labels."""
    rows = [(text, label) for text, label in rows if text.strip()]
    labels = np.array([label for _, label in rows], bool)
    if labels.all() or not labels.any():
        return None
    lines = line_features([text.encode() for text, _ in rows])
    text = np.repeat(np.arange(len(rows)), lines.sizes)
    mean, scale = lines.features.mean(axis=0), lines.features.std(axis=0) + 1e-6
    x = np.column_stack([(lines.features - mean) / scale, np.ones(len(text))])
    weight, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    truth = labels[text]
    # Both labels weigh the same in all, each document as one.
    weigh = np.where(labels, 0.5 / max(labels.sum(), 1), 0.5 / max((~labels).sum(), 1)) / lines.sizes
    follows = np.flatnonzero(np.diff(text) == 0) + 1  # lines with one before them
    weigh_pair = weigh[text[follows]]
    seen = np.diag([weigh_pair[~truth[follows]].sum(), weigh_pair[truth[follows]].sum()])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weight, pair)]
    for step in range(1, STEPS + 1):
        good = x @ weight
        forward, backward, logz = forward_backward(good, pair, lines.starts, lines.sizes)
        marginal = np.exp(forward[:, 1] + backward[:, 1] - logz[text])
        unary = np.column_stack([np.zeros(len(good)), good])
        b = (unary + backward)[follows] - logz[text[follows], None]
        joint = np.exp(forward[follows - 1][:, :, None] + pair + b[:, None, :])
        grads = (
            x.T @ ((marginal - truth) * weigh[text]) + DECAY * weight,
            np.einsum("nij,n->ij", joint, weigh_pair) - seen + DECAY * pair,
        )
        for param, (first, second), grad in zip((weight, pair), moments, grads):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            param -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return LineField(mean, scale, weight, pair)


def score_documents(docs: DataFrame, model: LineField | None) -> DataFrame:
    """`docs` with a `score` column over each whole text."""
    own = [c for c in docs.columns if c != "score"]
    if model is None:
        return docs.select(*own, F.lit(0.0).alias("score"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("__text").cast(pa.binary())
            scores = [model.scores(texts.slice(at, GROUP).to_pylist()) for at in range(0, len(texts), GROUP)]
            columns = [*part.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*own, "score"])

    rows = docs.select(*own, F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(batches, docs.select(*own, F.lit(0.0).alias("score")).schema)


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from `labels.quality`."""
    model = train(sample(docs, labels, "quality", FOLD, per_class))
    return score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id", in_fold(FOLD).alias("held_out"), "score", predicted("score").alias("predicted")
    )


def without_poor(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that are predicted good, with all their columns.

    Without labelled rows of both kinds nothing is known against any document, so all stay.
    """
    model = train(sample(docs, labels, "quality", FOLD, per_class))
    if model is None:
        return docs
    scored = score_documents(packed(docs, text_of()), model)
    return unpacked(scored.where(predicted("score") == 1))
