"""Items -> predictions: native scorers and the plug-in boundary."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions.arrays import (
    CHUNK,
    argmax,
    binary_scores,
    chunk_byte,
    cosine,
    digest_chunk,
    dot,
    l2_normalize,
    normalize_sum,
    sigmoid,
    softmax,
)
from gavel.functions.prompts import HYPOTHESIS, state_and_candidates
from gavel.functions.text import let
from gavel.schemas import validate_predictions
from gavel.session import checked_broadcast, materialize, release

MAX_SCALE = 100.0  # fixed value: upper bound of the contrastive scale
OFTEN = 1000  # items with one candidate list, from which on its vectors are broadcast
USES = 1_000_000  # of about 50 bytes: broadcast candidates of distinct lists


class Scorer(Protocol):
    """What a plug-in provides; `score_batch` is optional.

    `score` returns a dict with scores, predicted_index and optionally
    probabilities, latency_ms and usage.
    """

    def score(self, question: str, options: list[str]) -> dict[str, Any]: ...


RESULT = (
    "scores ARRAY<DOUBLE>, probabilities ARRAY<DOUBLE>, predicted_index INT, latency_ms DOUBLE, "
    "score_metadata STRUCT<usage: STRUCT<input_tokens: BIGINT, output_tokens: BIGINT>>"
)


def mock_scores(items: DataFrame, salt: Column | None = None, digest: Column | None = None) -> DataFrame:
    """Deterministic scorer: bytes of SHA-256(question) + 1, normalised.

    `salt` makes several models out of one item table; `digest` is the digest of
    salt and question where it is a column already. Digest and first chunk
    are columns of their own, computed once per row in generated code; only
    items with more than seven options decode further chunks.
    """
    text = F.col("question") if salt is None else F.concat(salt, F.lit(":"), F.col("question"))
    n = F.size("options")

    def seven(chunk: Column) -> Column:
        return F.array(*[chunk_byte(chunk, i).cast("double") + 1.0 for i in range(CHUNK)])

    short = seven(F.col("__c"))
    tail = F.transform(
        F.sequence(F.lit(1), ((n - 1) / CHUNK).cast("int")),
        lambda c: let(digest_chunk(F.col("__h"), c), seven),
    )
    data = (
        F.when(n <= CHUNK, F.slice(short, F.lit(1), n))
        .when(n <= 32, F.slice(F.concat(short, F.flatten(tail)), F.lit(1), n))
        .otherwise(F.raise_error(F.lit("at most 32 options")).cast("array<double>"))
    )
    return (
        items.withColumn("__h", F.sha2(text, 256) if digest is None else digest)
        .withColumn("__c", digest_chunk(F.col("__h"), 0))
        .withColumn("scores", data)
        .drop("__h", "__c")
        .withColumns(
            {
                "probabilities": normalize_sum(F.col("scores")),
                "predicted_index": argmax(F.col("scores")),
            }
        )
    )


def _run_batch(scorer: Any, batch: list[tuple[str, list[str]]], size: int) -> list[dict[str, Any]]:
    started = time.perf_counter()
    if size > 1 and hasattr(scorer, "score_batch"):
        results = scorer.score_batch(batch)
        share = (time.perf_counter() - started) * 1000 / len(batch)
        return [{"latency_ms": share, **r} for r in results]
    results = []
    for question, options in batch:
        started = time.perf_counter()
        result = scorer.score(question, options)
        results.append({"latency_ms": (time.perf_counter() - started) * 1000, **result})
    return results


def _score_frame(scorer: Any, frame: pd.DataFrame, batch_size: int) -> pd.DataFrame:
    """Score one Arrow batch; model batches share one option count."""
    results: list[dict[str, Any] | None] = [None] * len(frame)
    options = [list(o) for o in frame["options"]]
    by_count: dict[int, list[int]] = {}
    for i, o in enumerate(options):
        by_count.setdefault(len(o), []).append(i)
    questions = frame["question"].tolist()
    for rows in by_count.values():
        for at in range(0, len(rows), batch_size):
            chunk = rows[at : at + batch_size]
            batch = [(questions[i], options[i]) for i in chunk]
            for i, result in zip(chunk, _run_batch(scorer, batch, batch_size), strict=True):
                results[i] = result
    out = frame.copy()
    for name in ("scores", "probabilities", "predicted_index", "latency_ms"):
        out[name] = [r.get(name) for r in results]
    out["score_metadata"] = [{"usage": r.get("usage")} for r in results]
    return out


def score_items(
    items: DataFrame, factory: Callable[[], Scorer], batch_size: int = 1
) -> DataFrame:
    """Run a plug-in scorer over items.

    No shuffle: every Arrow batch is grouped by option count in place, however
    unequal the counts are. The factory runs once per task.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    result = T.StructType.fromDDL(RESULT)
    schema = T.StructType([*items.schema.fields, *result.fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for frame in frames:
            if len(frame):
                yield _score_frame(scorer, frame, batch_size)[schema.names]

    return validate_predictions(items.mapInPandas(run, schema))


# Statuses worth a retry and the delay limits in seconds.
RETRY_STATUSES = frozenset({429, 500, 502, 503, 504})
MAX_RETRY_AFTER = 5.0
FIRST_DELAY = 0.5
MAX_DELAY = 2.0


def delays(retries: int) -> list[float]:
    """Seconds to wait before each retry: doubling, bounded."""
    return [min(FIRST_DELAY * 2**k, MAX_DELAY) for k in range(retries)]


@dataclass
class RetryingClient:
    """Sends a payload through `post(payload) -> (status, headers, body)`, again after each delay."""

    post: Callable[[Any], tuple[int, dict[str, str], Any]]
    max_retries: int = 2
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, payload: Any) -> Any:
        status, headers, body = self.post(payload)
        for delay in delays(self.max_retries):
            if status not in RETRY_STATUSES:
                break
            asked = headers.get("retry-after")
            self.sleep(delay if asked is None else min(float(asked), MAX_RETRY_AFTER))
            status, headers, body = self.post(payload)
        if status >= 400:
            raise RuntimeError(f"request failed with status {status}")
        return body


def remote_answers(
    requests: DataFrame,
    client_factory: Callable[[], Callable[[str], str]],
    concurrency: int | None = None,
    request: str = "request",
) -> DataFrame:
    """Send the request column to a service; adds `response` and `latency_ms`.

    Request building and answer parsing stay column expressions. `concurrency`
    bounds the number of tasks that call the service at once.
    """
    if concurrency is not None:
        requests = requests.repartition(concurrency)
    schema = T.StructType(
        [
            *requests.schema.fields,
            T.StructField("response", T.StringType()),
            T.StructField("latency_ms", T.DoubleType()),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = client_factory()
        for frame in frames:
            bodies, times = [], []
            for payload in frame[request]:
                started = time.perf_counter()
                bodies.append(send(payload))
                times.append((time.perf_counter() - started) * 1000)
            yield frame.assign(response=bodies, latency_ms=times)[schema.names]

    return requests.mapInPandas(run, schema)


def _scored(df: DataFrame, scores: Column, probabilities: Column, predicted: Column) -> DataFrame:
    return df.withColumns(
        {
            "scores": scores,
            "probabilities": probabilities,
            "predicted_index": predicted.cast("int"),
        }
    )


def linear_head(vector: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Logit w.x + b."""
    return dot(vector, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))


def linear_yes_no(
    df: DataFrame, weights: Sequence[float], bias: float = 0.0, vector: str = "embedding"
) -> DataFrame:
    """Yes/no from a linear head over one state vector."""
    staged = df.withColumn("logit", linear_head(F.col(vector), weights, bias))
    scores, probabilities, predicted = binary_scores(sigmoid(F.col("logit")), F.col("logit"))
    return _scored(staged, scores, probabilities, predicted).drop("logit")


def linear_candidates(
    df: DataFrame, weights: Sequence[float], bias: float = 0.0, candidates: str = "candidates"
) -> DataFrame:
    """Choice / ordinal from one linear head over the candidate vectors of a row.

    Candidates stay inside their row, so nothing is exploded or shuffled.
    """
    staged = df.withColumn(
        "scores", F.transform(candidates, lambda v: linear_head(v, weights, bias))
    )
    staged = staged.withColumn("probabilities", softmax(F.col("scores")))
    return staged.withColumn("predicted_index", argmax(F.col("probabilities")))


def contrastive(
    df: DataFrame,
    scale: float,
    state: str = "state_vector",
    candidates: str = "candidate_vectors",
    task: str = "task",
    unit_length: bool = False,
) -> DataFrame:
    """Softmax over the scaled cosine of the state with every candidate.

    Vectors that already have unit length need only the dot product.
    """
    capped = min(scale, MAX_SCALE)
    similarity = dot if unit_length else cosine
    logits = F.transform(candidates, lambda v: similarity(F.col(state), v) * capped)
    staged = df.withColumn("logits", logits).withColumn("__p", softmax(F.col("logits")))
    yes_no, y_prob, y_pred = binary_scores(F.get("__p", F.lit(1)))
    noul = F.col(task) == "noul"
    return _scored(
        staged,
        F.when(noul, yes_no).otherwise(F.col("__p")),
        F.when(noul, y_prob).otherwise(F.col("__p")),
        F.when(noul, y_pred).otherwise(argmax(F.col("__p"))),
    ).drop("__p")


def _mark(text: Column) -> Column:
    """Identity of a text: half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def encode_once(
    items: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """State and candidate vectors of unit length, every distinct text encoded once.

    `encode` maps a (text) table to (text, vector). Adds `state_vector` and
    `candidate_vectors`. A text travels once; everything else is joined by digests.
    Vectors are written to the shared folder as the encoder gives them, and those of a
    candidate list are put together once, however many items have it. Lists of OFTEN
    items or more are broadcast up to a checked number of them, behind the other
    joins, so no item travels with the vectors of a list that many share. The joins are
    between written tables and scans: adaptive execution can split a partition full
    of copies of one text.
    """
    state, candidates = state_and_candidates(F.col("task"), F.col("question"), F.col("options"))
    keyed = items.withColumns({"__state": state, "__texts": candidates}).where("__texts IS NOT NULL")
    words = keyed.select(F.explode(F.concat(F.array("__state"), "__texts")).alias("text"))
    vectors = encode(words.where("text IS NOT NULL").distinct())
    vectors = materialize(vectors.select(_mark(F.col("text")).alias("mark"), "vector"), "vectors")

    keyed = keyed.withColumn("__marks", F.transform("__texts", _mark)).withColumn("__mark", _mark(F.col("__state")))
    parts = F.transform("__marks", lambda m: F.coalesce(F.hex(m), F.lit("")))
    keyed = keyed.withColumn("__key", _mark(F.concat_ws(",", parts))).drop("__state", "__texts")
    lists = keyed.groupBy("__key", "__marks").agg(F.count(F.lit(1)).alias("n"))
    uses = materialize(lists.select("__key", "n", F.posexplode_outer("__marks").alias("pos", "mark")), "uses")
    found = checked_broadcast(uses.where("mark IS NOT NULL"), USES).join(vectors, "mark").select("__key", "n", "pos", "vector")
    missing = uses.where("mark IS NULL").select("__key", "n", "pos", F.lit(None).cast(vectors.schema["vector"].dataType).alias("vector"))
    # An item has few candidates.
    packed = found.unionByName(missing).groupBy("__key", "n").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "vector"))), lambda s: l2_normalize(s["vector"])).alias("__v")
    )
    packed = materialize(packed, "packed")
    release(items.sparkSession, uses)

    keyed = keyed.drop("__marks")
    often, seldom = packed.where(F.col("n") >= OFTEN), packed.where(F.col("n") < OFTEN).select("__key", "__v")
    shared = checked_broadcast(often.select("__key"))
    own = keyed.join(shared, "__key", "left_anti").join(seldom, "__key")
    rest = keyed.join(shared, "__key", "left_semi").withColumn("__v", F.lit(None).cast(packed.schema["__v"].dataType))
    joined = own.unionByName(rest).join(vectors.withColumnsRenamed({"mark": "__mark", "vector": "__s"}), "__mark", "left")
    joined = joined.join(checked_broadcast(often.select("__key", F.col("__v").alias("__often"))), "__key", "left")
    return joined.withColumns(
        {
            "state_vector": l2_normalize(F.col("__s")),
            "candidate_vectors": F.slice(F.coalesce("__v", "__often"), F.lit(1), F.size("options")),
        }
    ).drop("__v", "__often", "__s", "__key", "__mark")


class PairScorer(Protocol):
    """Plug-in entailment scorer over (premise, hypothesis) pairs."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def entailment(
    items: DataFrame,
    factory: Callable[[], PairScorer],
    language: str = "ja",
    pair_batch: int = 256,
) -> DataFrame:
    """One hypothesis per option, scored independently; probabilities stay NULL.

    Options are expanded and regrouped inside the Arrow batch, without a shuffle.
    """
    template = HYPOTHESIS[language]
    result = T.StructType.fromDDL(RESULT)
    schema = T.StructType([*items.schema.fields, *result.fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for frame in frames:
            started = time.perf_counter()
            options = [list(o) for o in frame["options"]]
            pairs = [
                (question, template.replace("{option}", option))
                for question, row in zip(frame["question"], options)
                for option in row
            ]
            flat: list[float] = []
            for at in range(0, len(pairs), pair_batch):
                flat += list(score(pairs[at : at + pair_batch]))
            scores, at = [], 0
            for row in options:
                scores.append([float(v) for v in flat[at : at + len(row)]])
                at += len(row)
            share = (time.perf_counter() - started) * 1000 / max(1, len(frame))
            out = frame.assign(
                scores=scores,
                probabilities=None,
                predicted_index=[max(range(len(s)), key=s.__getitem__) for s in scores],
                latency_ms=share,
                score_metadata=[{"usage": None}] * len(frame),
            )
            yield out[schema.names]

    return items.mapInPandas(run, schema)


def few_shot_pack(examples: DataFrame, count: int, order: str, key: str = "task") -> DataFrame:
    """First `count` examples per key as one array: one bounded row per key."""
    from gavel.operators.ranking import top_per_group

    first = top_per_group(examples, [key], [F.col(order)], count, F.col(order))
    entry = F.struct(order, "question", "options", "gold_index")
    return first.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(
                e["question"].alias("question"),
                e["options"].alias("options"),
                e["gold_index"].alias("gold_index"),
            ),
        ).alias("examples")
    )


def with_few_shot(items: DataFrame, pack: DataFrame, key: str = "task") -> DataFrame:
    """Attach each key's example pack; keys without examples get an empty pack."""
    empty = F.array().cast(pack.schema["examples"].dataType)
    return items.join(checked_broadcast(pack), key, "left").withColumn(
        "examples", F.coalesce("examples", empty)
    )


