"""Hard negatives of anchors by slots of scores.

Vectors become integers, floor(scale * x), and a row's score is its inner product
with the anchor. Rows are dealt by hash into units, anchors into groups; each pair
of unit and group is one task's work of bounded size, whatever the labels' sizes.

A first pass finds each anchor's positives, its best rows of the same label. A
positive of score p admits negatives between low % and high % of p. The positives'
upper limits split all scores into disjoint slots, the first slot on top: a score
in slot j is within the limits of the slots up to j and above those of the others.
The second pass keeps the k best rows of another label for every anchor and slot,
in each unit and then over all units. An overlapping window is then answered from
its own slot and those below: their lists follow one another in falling order, so
the first k of that suffix are the first k below the limit, and those of them that
reach the lower limit are the result. Each row is scored once for all windows.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; a shorter vector counts as filled up with zeros; rows that
repeat id, label and vector count once; different rows under one id are anchors and
candidates of their own, but never those of their own id; ties go to the smaller
id; an anchor without positives, a positive of negative score and a window without
rows give no result; empty tables give an empty result; extra columns are left out.
A score times the larger of the two percentages must fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.topk import EXACT, matrix
from gavel.session import materialize

UNIT, GROUP = 8192, 4096
STEP = 128  # anchors that are scored in one go


def first(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The first k of `places`, which ascend by id, in falling order of their scores."""
    own = scores[places]
    if len(own) > k:
        near = own >= np.partition(own, len(own) - k)[len(own) - k]
        places, own = places[near], own[near]
    return places[np.argsort(-own, kind="stable")[:k]]


def slots_of(scores: np.ndarray, uppers: np.ndarray) -> np.ndarray:
    """Slot of each score under descending `uppers`; -1 above all of them."""
    return len(uppers) - 1 - np.searchsorted(uppers[::-1], scores, "left")


def _width(lists: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in lists.chunks), default=0)


def _scored(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each anchor's place and its scores with the rows."""
    width = max(_width(rows.column("q")), _width(anchors.column("q")))
    left, right = matrix(rows.column("q"), width), matrix(anchors.column("q"), width)
    reach = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(width, 1)
    if reach < EXACT:
        left, right = left.astype(np.float64), right.astype(np.float64)
    for at in range(0, len(right), STEP):
        for place, scores in enumerate(right[at : at + STEP] @ left.T, at):
            yield place, scores.astype(np.int64)


def _blocks(rows: DataFrame, anchors: DataFrame, unit: int, group: int, find: Callable, schema: str) -> DataFrame:
    """`find` over every pair of a unit of rows and a group of anchors."""
    units, groups = max(1, -(-rows.count() // unit)), max(1, -(-anchors.count() // group))
    left = rows.withColumn("unit", F.expr(f"pmod(h, {units}L)")).withColumn("grp", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
    right = anchors.withColumn("grp", F.expr(f"pmod(shiftright(h, 20), {groups}L)")).withColumn(
        "unit", F.explode(F.expr(f"sequence(0L, {units - 1}L)"))
    )
    return left.groupBy("unit", "grp").cogroup(right.groupBy("unit", "grp")).applyInArrow(find, schema)


def _table(parts: list[tuple], names: tuple[str, ...]) -> pa.Table:
    """Rows of (anchor's id, anchor's hash, constant columns..., arrays...) as one table of longs."""
    sizes = [len(part[-1]) for part in parts]
    columns = zip(*parts) if parts else [()] * len(names)
    arrays = [
        np.concatenate(c) if c and isinstance(c[0], np.ndarray) else np.repeat(np.array(c, np.int64), sizes) for c in columns
    ]
    return pa.table({n: pa.array(a, pa.int64()) for n, a in zip(names, arrays)})


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, q and their hash h, of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    own = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q")).distinct()


def best_positives(rows: DataFrame, anchors: DataFrame, count: int, unit: int, group: int) -> DataFrame:
    """anchor_id, h, positive_id, positive_score: each anchor's first `count` other rows of its label."""
    names = ("anchor_id", "h", "positive_id", "positive_score")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("vec_id")
        ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
        own, own_labels, keys = (right.column(c).to_numpy() for c in ("vec_id", "label", "h"))
        parts = []
        for at, scores in _scored(left, right):
            places = first(scores, np.flatnonzero((labels == own_labels[at]) & (ids != own[at])), count)
            parts.append((own[at], keys[at], ids[places], scores[places]))
        return _table(parts, names)

    found = _blocks(rows, anchors, unit, group, find, ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("anchor_id", "h").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def best_in_slots(rows: DataFrame, anchors: DataFrame, k: int, unit: int, group: int) -> DataFrame:
    """anchor_id, h, slot, negative_id, negative_score: the k best of each slot.

    Anchors carry `uppers`, the slots' descending limits, and `floor`, the least score of any window.
    """
    names = ("anchor_id", "h", "slot", "negative_id", "negative_score")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("vec_id")
        ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
        own, own_labels, keys, floors = (right.column(c).to_numpy() for c in ("vec_id", "label", "h", "floor"))
        limits = [np.array(u, np.int64) for u in right.column("uppers").to_pylist()]
        parts = []
        for at, scores in _scored(left, right):
            uppers = limits[at]
            inside = (scores >= floors[at]) & (scores <= uppers[0]) & (labels != own_labels[at]) & (ids != own[at])
            places = np.flatnonzero(inside)
            slots = slots_of(scores[places], uppers)
            for slot in range(len(uppers)):
                best = first(scores, places[slots == slot], k)
                parts.append((own[at], keys[at], slot, ids[best], scores[best]))
        return _table(parts, names)

    found = _blocks(rows, anchors, unit, group, find, ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("anchor_id", "h", "slot").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, unit: int = UNIT, group: int = GROUP,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    `vectors` has vec_id, label and embedding. The negatives n of a positive of
    score p satisfy low * p <= 100 * n <= high * p.
    """
    if not 0 <= low <= high:
        raise ValueError("0 <= low <= high is needed")
    rows = quantised(vectors, scale).withColumn("h", F.xxhash64("vec_id", "label", "q"))
    rows = materialize(rows, "negatives-vectors")
    anchors = rows.where(is_anchor)
    found = best_positives(rows, anchors, positives, unit, group).where("positive_score >= 0")
    windows = found.withColumn("upper", F.expr(f"({high} * positive_score) div 100")).withColumn(
        "lower", F.expr(f"({low} * positive_score + 99) div 100")
    )
    windows = materialize(windows.drop("place"), "negatives-windows")
    limits = windows.groupBy("anchor_id", "h").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("floor")
    )
    limited = anchors.withColumnRenamed("vec_id", "anchor_id").join(limits, ["anchor_id", "h"])
    limited = materialize(limited.withColumnRenamed("anchor_id", "vec_id"), "negatives-anchors")

    falling = F.struct("slot", (-F.col("negative_score")).alias("down"), "negative_id")
    slots = best_in_slots(rows, limited, k, unit, group).groupBy("anchor_id", "h").agg(
        F.sort_array(F.collect_list(falling)).alias("best")  # k rows a slot, a slot a positive at most
    )
    asked = windows.join(limited.select(F.col("vec_id").alias("anchor_id"), "h", "uppers"), ["anchor_id", "h"])
    asked = asked.withColumn("slot", F.array_position("uppers", F.col("upper")) - 1)
    suffix = F.filter("best", lambda x: x["slot"] >= F.col("slot"))
    within = F.filter(F.slice(suffix, 1, k), lambda x: -x["down"] >= F.col("lower"))
    return (
        asked.join(slots, ["anchor_id", "h"])
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(within).alias("at", "negative"))
        .select(
            "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("negative.negative_id").alias("negative_id"),
            "positive_score", (-F.col("negative.down")).alias("negative_score"),
        )
    )
