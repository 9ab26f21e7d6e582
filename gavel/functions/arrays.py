"""Array expressions: probabilities, seeded shuffles and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel.functions.text import let, numeric_text, seeded_hash

FLOOR = 1e-12  # fixed value: smallest probability inside a logarithm


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def argmax(values: Column) -> Column:
    """Index of the largest value, the lowest one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def normalize_sum(values: Column) -> Column:
    return let(array_sum(values), lambda total: F.transform(values, lambda v: v / total))


def softmax(logits: Column) -> Column:
    """Stable softmax."""
    return let(
        F.array_max(logits),
        lambda top: let(F.transform(logits, lambda v: F.exp(v - top)), normalize_sum),
    )


def rescale(probabilities: Column, temperature: Column | float) -> Column:
    """softmax(ln max(p, floor) / T); never reorders the options."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    logs = F.transform(probabilities, lambda p: F.log(F.greatest(p, F.lit(FLOOR))) / t)
    return let(logs, softmax)


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def binary_scores(p_true: Column, logit: Column | None = None) -> tuple[Column, Column, Column]:
    """(scores, probabilities, predicted) of a yes/no answer; a tie at 0.5 is yes."""
    scores = F.array(F.lit(0.0), p_true if logit is None else logit)
    probabilities = F.array(F.lit(1.0) - p_true, p_true)
    return scores, probabilities, F.when(p_true >= 0.5, 1).otherwise(0)


def seeded_shuffle(values: Column, seed: int | str, key: Column) -> Column:
    """Order an array of texts by a seeded hash of each element."""
    tagged = F.transform(values, lambda v: F.concat(seeded_hash(seed, key, v), v))
    return F.transform(F.sort_array(tagged), lambda t: F.substring(t, F.lit(65), F.length(t)))


CHUNK = 7  # bytes decoded by one hex conversion: 56 bits fit a bigint


def digest_chunk(hexed: Column, chunk: Column | int) -> Column:
    """Seven digest bytes (zero-padded at the end) as one bigint."""
    at = F.lit(chunk * 2 * CHUNK + 1) if isinstance(chunk, int) else chunk * 2 * CHUNK + 1
    digits = F.rpad(F.substring(hexed, at, F.lit(2 * CHUNK)), 2 * CHUNK, "0")
    return F.conv(digits, 16, 10).cast("bigint")


def chunk_byte(chunk: Column, i: int) -> Column:
    """Byte `i` of a chunk."""
    return F.shiftright(chunk, 8 * (CHUNK - 1 - i)).bitwiseAND(F.lit(255)).cast("int")


def digest_bytes(text: Column, count: Column | int) -> Column:
    """First `count` (at most 32) bytes of SHA-256(text) as ints."""
    n = F.lit(count) if isinstance(count, int) else count
    indices = F.sequence(F.lit(0), ((n - 1) / CHUNK).cast("int"))

    def seven(chunk: Column) -> Column:
        return F.array(*[chunk_byte(chunk, i) for i in range(CHUNK)])

    def decode(hexed: Column) -> Column:
        parts = F.transform(indices, lambda c: let(digest_chunk(hexed, c), seven))
        return F.slice(F.flatten(parts), F.lit(1), n)

    return let(F.sha2(text, 256), decode)


# The distractor rules of numeric multiple choice.
DISTRACTOR_DELTAS = (1, -1, 2, -2, 3, -3, 5, -5, 10, -10)
DISTRACTOR_FACTORS = (0.5, 2.0, 3.0, 10.0)
DISTRACTOR_RANGE = 50
DISTRACTOR_STEPS = 5
DISTRACTOR_SCALE = 0.1
POOL_SIZES = (
    len(DISTRACTOR_DELTAS),
    len(DISTRACTOR_FACTORS),
    2 * DISTRACTOR_RANGE + 1,
    2 * DISTRACTOR_STEPS,
)


def distractor_pools(gold: Column) -> list[Column]:
    """The four candidate pools around a numeric answer."""
    scale = F.greatest(F.lit(1.0), F.abs(gold) * DISTRACTOR_SCALE)
    steps = [s * k for s in (-1, 1) for k in range(1, DISTRACTOR_STEPS + 1)]
    return [
        F.array(*[gold + float(d) for d in DISTRACTOR_DELTAS]),
        F.array(*[gold * f for f in DISTRACTOR_FACTORS]),
        F.transform(
            F.sequence(F.lit(-DISTRACTOR_RANGE), F.lit(DISTRACTOR_RANGE)),
            lambda d: gold + d.cast("double"),
        ),
        F.array(*[gold + scale * float(k) for k in steps]),
    ]


def _draw(gold: Column, data: Column, t: int) -> Column:
    """Draw `t` picks one value of pool `t mod 4` by a byte of the digest's chunks, computed without building the pool."""
    size = POOL_SIZES[t % 4]
    i = chunk_byte(F.get(data, F.lit(t // CHUNK)), t % CHUNK) % size
    if t % 4 == 0:
        deltas = F.array(*[F.lit(float(d)) for d in DISTRACTOR_DELTAS])
        return gold + F.get(deltas, i)
    if t % 4 == 1:
        return gold * F.get(F.array(*[F.lit(f) for f in DISTRACTOR_FACTORS]), i)
    if t % 4 == 2:
        return gold + (i - DISTRACTOR_RANGE).cast("double")
    scale = F.greatest(F.lit(1.0), F.abs(gold) * DISTRACTOR_SCALE)
    step = F.when(i < DISTRACTOR_STEPS, -(i + 1)).otherwise(i - DISTRACTOR_STEPS + 1)
    return gold + scale * step.cast("double")


def numeric_options(gold: Column, count: int, seed: int | str, key: Column) -> Column:
    """`count` distinct numeric options, the gold text among them, in seeded order.

    Digest bytes draw from the four pools in turn. Mostly the first draws give
    enough distinct values, so the others are only computed where they do not.
    Should all give too few, the pools themselves follow as a reserve; a number
    that even they cannot give is an error.
    """
    draws = min(32, 3 * count)
    first = min(draws, CHUNK * -(-7 * count // (5 * CHUNK)))
    data = F.sha2(F.concat_ws(":", F.lit(str(seed)), key, gold), 256)

    def wrong(s: Column) -> Column:
        value, hexed = s["value"], s["data"]

        def picks(n: int) -> Column:
            chunks = F.array(*[digest_chunk(hexed, c) for c in range(-(-n // CHUNK))])
            drawn = let(chunks, lambda b: F.array(*[_draw(value, b, t) for t in range(n)]))
            return F.array_distinct(_texts(drawn, gold))

        def enough(picked: Column) -> Column:
            rest = F.array_union(picked, _texts(F.concat(*distractor_pools(value)), gold))
            chosen = F.when(F.size(picked) >= count - 1, picked).otherwise(rest)
            few = F.raise_error(F.lit(f"fewer than {count - 1} distinct wrong options")).cast("array<string>")
            return F.when(F.size(chosen) < count - 1, few).otherwise(F.slice(chosen, 1, count - 1))

        def all_if_few(picked: Column) -> Column:
            return F.when(F.size(picked) >= count - 1, picked).otherwise(picks(draws))

        return let(let(picks(first), all_if_few), enough)

    bound = F.struct(gold.cast("double").alias("value"), data.alias("data"))
    return seeded_shuffle(F.concat(F.array(gold), let(bound, wrong)), seed, key)


def _texts(values: Column, gold: Column) -> Column:
    return F.array_remove(F.transform(values, numeric_text), gold)


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(as_double(left), as_double(right), lambda a, b: a * b))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    norm = F.greatest(l2_norm(vector), F.lit(FLOOR))
    return let(norm, lambda n: F.transform(as_double(vector), lambda v: v / n))


def cosine(left: Column, right: Column) -> Column:
    norms = F.greatest(l2_norm(left), F.lit(FLOOR)) * F.greatest(l2_norm(right), F.lit(FLOOR))
    return dot(left, right) / norms


def mean_pool(states: Column) -> Column:
    """Element-wise mean of an ARRAY<ARRAY<DOUBLE>>."""
    total = F.aggregate(
        F.slice(states, F.lit(2), F.greatest(F.size(states) - 1, F.lit(0))),
        as_double(F.get(states, F.lit(0))),
        lambda acc, row: F.zip_with(acc, as_double(row), lambda a, b: a + b),
    )
    return F.transform(total, lambda v: v / F.size(states))


def layer_norm(vector: Column, epsilon: float = 1e-5) -> Column:
    """Parameter-free layer norm: zero mean, unit (population) variance."""

    def scaled(centred: Column) -> Column:
        variance = dot(centred, centred) / F.size(centred)
        return let(
            F.sqrt(variance + epsilon),
            lambda deviation: F.transform(centred, lambda v: v / deviation),
        )

    values = as_double(vector)
    return let(
        array_sum(values) / F.size(values),
        lambda mean: let(F.transform(values, lambda v: v - mean), scaled),
    )
