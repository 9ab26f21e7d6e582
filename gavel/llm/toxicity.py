"""Toxicity from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, with marks at both ends, hashed into
rows of one embedding table. The mean of a word's rows, averaged over a window of
consecutive words, goes into a linear softmax of two labels. A document is toxic
if any of its windows is (noisy or), so a few words count the same in a long text
as in a short one. Embeddings and softmax are fitted together by Adam on all
sampled documents at once; as the n-grams of a misspelt or unseen word are mostly
those of known ones, it lands near them.

Learning uses at most PER_CLASS documents a label outside the held-out fold, a
bounded sample; every document is scored over its whole text. The model that goes
to the tasks is one number per embedding row.

Defined cases: a null, empty or blank text has the score of a window without
words; without labelled rows of both kinds every score is 0; a null id is in the
fold of the empty text; repeated rows are scored alike; an empty table gives an
empty result; extra columns stay (`score_documents`) or are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.labelled import in_fold, predicted, sample
from gavel.llm.rows import packed, text_of, unpacked

FOLD = (3, 1)  # ids that teach nothing: modulus and remainder
PER_CLASS = 2000  # sampled documents of each label at most
BUCKETS = 1 << 19  # rows of the embedding table
NGRAMS = (3, 4, 5)
WINDOW = 2  # words
DIM = 8
STEPS, RATE, DECAY = 80, 0.05, 1e-5
KNOWN_WORDS = 300_000  # words a task remembers before it starts anew
ROWS = 16_384  # embedding rows that are updated in one go
PIECE = 20_000  # words whose n-grams are made in one go


def ngram_bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words' n-grams, and where each word's begin."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters to the word's end
    own, rows = [], []
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            at = np.flatnonzero(room >= n)
            code = np.full(len(at), n, np.uint64)
            for k in range(n):
                code = (code ^ chars[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            own.append(word[at])
            rows.append((code % np.uint64(BUCKETS)).astype(np.int32))
    own, rows = np.concatenate(own), np.concatenate(rows)
    order = np.argsort(own, kind="stable")
    # Every word with its marks has three characters and so at least one n-gram.
    return rows[order], np.searchsorted(own[order], np.arange(len(words)))


def word_means(values: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(starts, len(rows)))
    return np.add.reduceat(values[rows], starts) / sizes


class Bags:
    """The n-gram bags of many words in pieces, so that no step holds a wide array of all n-grams."""

    def __init__(self, words: list[str]):
        self.pieces = [ngram_bags(words[at : at + PIECE]) for at in range(0, len(words), PIECE)]
        self.sizes = np.concatenate([np.diff(np.append(starts, len(rows))) for rows, starts in self.pieces])
        seen = np.zeros(BUCKETS, bool)
        for rows, _ in self.pieces:
            seen[rows] = True
        self.used = np.flatnonzero(seen)  # from here on rows are places among these
        place = np.cumsum(seen, dtype=np.int32) - 1
        for at, (rows, starts) in enumerate(self.pieces):
            self.pieces[at] = (place[rows], starts)

    def means(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([word_means(values, *piece) for piece in self.pieces])

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Of a number for each word, the sum over the words of each used row's n-grams."""
        total, at = np.zeros(len(self.used)), 0
        for rows, starts in self.pieces:
            own = slice(at, at + len(starts))
            total += np.bincount(rows, np.repeat(per_word[own], self.sizes[own]), len(total))
            at += len(starts)
        return total


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many words each: starts and sizes of the windows, and the text of each."""
    per_text = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), per_text)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = (np.cumsum(sizes) - sizes)[text] + place * WINDOW
    return starts, np.minimum(WINDOW, sizes[text] - place * WINDOW), text


@dataclass
class SubwordModel:
    """`weight` per embedding row and `bias`: the softmax's log-odds are linear in both."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: Iterable[str | None], known: dict[str, float]) -> np.ndarray:
        """Probability of label 1 of every text; `known` remembers words."""
        tokens, sizes = [], []
        for text in texts:
            words = (text or "").lower().split()
            tokens += words
            sizes.append(len(words))
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = list(set(tokens) - known.keys())
        for at in range(0, len(new), PIECE):
            part = new[at : at + PIECE]
            known.update(zip(part, word_means(self.weight, *ngram_bags(part)).tolist()))
        values = np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        return self.pooled(values, np.array(sizes, np.int64))

    def pooled(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        clean = np.where(sizes == 0, -np.logaddexp(0, self.bias), 0.0)  # log probability of no toxic window
        starts, counts, text = windows(sizes)
        if len(starts):
            logits = np.add.reduceat(values, starts) / counts + self.bias
            clean += np.bincount(text, -np.logaddexp(0, logits), len(sizes))
        return -np.expm1(clean)


def _adam(moments: Iterable[np.ndarray], grad: np.ndarray, step: int) -> np.ndarray:
    """The step of a parameter; its moments move along in place."""
    first, second = moments
    first += 0.1 * (grad - first)
    second += 0.01 * (grad * grad - second)
    return RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)


def train(rows: list[tuple[str, int]], seed: int = 0) -> SubwordModel | None:
    """Fit embeddings and softmax to (text, label); None without both labels."""
    labels = np.array([label for _, label in rows], bool)
    if labels.all() or not labels.any():
        return None
    ids: dict[str, int] = {}
    tokens, sizes = [], []
    for text, _ in rows:
        words = text.lower().split()
        tokens.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
        sizes.append(len(words))
    sizes = np.array(sizes, np.int64)
    labels, sizes, token = labels[sizes > 0], sizes[sizes > 0], np.concatenate(tokens)
    known = len(ids)
    bags = Bags(list(ids))
    del ids, tokens  # the driver keeps numbers only
    starts, counts, text = windows(sizes)
    rng = np.random.default_rng(seed)
    table = rng.standard_normal((len(bags.used), DIM), np.float32) * np.float32(0.1)
    # Rows of the softmax; only their difference matters for the log-odds.
    softmax, bias = rng.normal(0, 0.5, (2, DIM)), -np.log(np.median(np.bincount(text))) - 2.0
    weigh = np.where(labels, 0.5 / labels.sum(), 0.5 / (~labels).sum())
    table_moments, softmax_moments, bias_moments = ((np.zeros_like(p), np.zeros_like(p)) for p in (table, softmax, np.zeros(1)))
    for step in range(1, STEPS + 1):
        direction = (softmax[1] - softmax[0]).astype(np.float32)
        values = bags.means(table @ direction)
        logits = np.add.reduceat(values[token], starts) / counts + bias
        toxic = 1 / (1 + np.exp(-logits))
        found = -np.expm1(np.bincount(text, -np.logaddexp(0, logits), len(sizes)))
        # Slope of the noisy-or likelihood in a window's log-odds.
        pull = np.where(labels, -(1 - found) / np.maximum(found, 1e-9), 1.0) * weigh
        slope = pull[text] * toxic
        per_word = np.bincount(token, np.repeat(slope * (1.0 / counts), counts), known) / bags.sizes
        per_row = bags.sums(per_word).astype(np.float32)
        toward = per_row @ table
        for at in range(0, len(table), ROWS):
            own = slice(at, at + ROWS)
            grad = np.outer(per_row[own], direction) + DECAY * table[own]
            table[own] -= _adam([m[own] for m in table_moments], grad, step)
        softmax -= _adam(softmax_moments, np.stack([-toward, toward]), step)
        bias -= _adam(bias_moments, np.array([slope.sum()]), step)[0]
    weight = np.zeros(BUCKETS, np.float32)
    weight[bags.used] = table @ (softmax[1] - softmax[0])
    return SubwordModel(weight, float(bias))


def score_documents(docs: DataFrame, model: SubwordModel | None) -> DataFrame:
    """`docs` with a `score` column over each whole text."""
    own = [c for c in docs.columns if c != "score"]
    if model is None:
        return docs.select(*own, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, known = SubwordModel(*shared.value), {}
        for part in parts:
            scores = []
            for at in range(0, part.num_rows, 500):
                scores.append(scorer.scores(part.column("__text").slice(at, 500).to_pylist(), known))
            columns = [*part.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*own, "score"])

    rows = docs.select(*own, F.col("text").cast("string").alias("__text"))
    schema = docs.select(*own, F.lit(0.0).cast("double").alias("score")).schema
    return rows.mapInArrow(batches, schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from `labels.toxic`."""
    model = train(sample(docs, labels, "toxic", FOLD, per_class))
    return score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id", in_fold(FOLD).alias("held_out"), "score", predicted("score").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = train(sample(docs, labels, "toxic", FOLD, per_class))
    scored = score_documents(packed(docs, text_of()), model)
    return unpacked(scored.where(predicted("score") == 0))
