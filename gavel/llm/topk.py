"""Exact top-k search by inner product with KD-trees.

Vectors become integers, floor(scale * x). They are dealt by hash into units of
about UNIT rows, queries into groups of about GROUP; each pair of unit and group
is one task's work of bounded size, whatever the table's. Inside a unit every
shard of SHARD rows gets a KD-tree: median splits along the widest dimension, a
tight box and the smallest id for each node. A query walks a tree best-first by
the largest inner product that a box allows, and stops when no box can beat its
k-th score so far, which it takes along from tree to tree. Ties go to the smaller
id, in the walk as in the result, so a great number of equal vectors costs a few
leaves. Units' results meet in a ranked window per query.

Defined cases: null ids, null vectors and vectors with null or non-finite
components take no part; a shorter vector counts as filled up with zeros; rows
that repeat id and vector count once; different vectors under one id are
candidates and queries of their own, and never candidates of their own id; fewer
than k candidates give fewer ranks; empty tables give an empty result; extra
columns are left out. Scores must fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.session import materialize

UNIT, GROUP, SHARD, LEAF = 8192, 4096, 4096, 128
EXACT = 1 << 53  # below, sums of doubles are exact integers


class KdTree:
    """Boxes, smallest ids and leaves of one shard's points, which are put in tree order."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order, todo, spans, children = np.argsort(ids, kind="stable"), [0], [(0, len(ids))], {}
        while todo:
            node = todo.pop()
            start, end = spans[node]
            if end - start <= LEAF:
                continue
            own = points[order[start:end]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            # Stable: equal vectors stay in the order of their ids.
            order[start:end] = order[start:end][np.argsort(own[:, axis], kind="stable")]
            middle = (start + end) // 2
            children[node] = (len(spans), len(spans) + 1)
            spans += [(start, middle), (middle, end)]
            todo += children[node]
        self.points, self.ids = points[order], ids[order]
        self.spans, self.children = spans, children
        self.low = np.array([self.points[i:j].min(axis=0) for i, j in spans])
        self.high = np.array([self.points[i:j].max(axis=0) for i, j in spans])
        self.least = [int(self.ids[i:j].min()) for i, j in spans]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, best: list[tuple], k: int) -> None:
        """Fold the shard into `best`, a heap of the k best (score, -id) so far."""
        heap = [(-bounds[0], self.least[0], 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            if len(best) == k and (-bound, -least) < best[0]:
                return
            if node in self.children:
                for child in self.children[node]:
                    if len(best) < k or (bounds[child], -self.least[child]) > best[0]:
                        heapq.heappush(heap, (-bounds[child], self.least[child], child))
                continue
            start, end = self.spans[node]
            scores = self.points[start:end] @ query
            near = np.flatnonzero(scores >= best[0][0]) if len(best) == k else np.arange(end - start)
            for at in near.tolist():
                vec_id = int(self.ids[start + at])
                if vec_id == own:
                    continue
                item = (int(scores[at]), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of `width` integers, filled up with zeros."""
    out = np.zeros((len(lists), width), np.int64)
    at = 0
    for chunk in lists.chunks:
        sizes = np.diff(chunk.offsets.to_numpy())
        flat = chunk.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(at, at + len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        at += len(sizes)
    return out


def search_unit(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[list[tuple]]:
    """For each query the best (score, -id) of the points, by trees of SHARD points each."""
    reach = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(points.shape[1], 1)
    kind = np.float64 if reach < EXACT else np.int64
    points, queries = points.astype(kind), queries.astype(kind)
    trees = [KdTree(points[at : at + SHARD], ids[at : at + SHARD]) for at in range(0, len(ids), SHARD)]
    for at in range(0, len(query_ids), 256):
        part = queries[at : at + 256]
        bounds = [tree.bounds(part) for tree in trees]
        for row, own in enumerate(query_ids[at : at + 256].tolist()):
            best: list[tuple] = []
            # The most promising shard first: its k-th score prunes the others.
            for tree in sorted(range(len(trees)), key=lambda t: -bounds[t][row][0]):
                trees[tree].search(part[row], own, bounds[tree][row].tolist(), best, k)
            yield best


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and q, floor(scale * x) of every component, of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), q.alias("q")
    ).distinct()


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, unit: int = UNIT, group: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k best of all other rows."""

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lists = [t.column("q") for t in (left, right)]
        width = max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for x in lists for c in x.chunks), default=0)
        ids, query_ids = (t.column("vec_id").to_numpy() for t in (left, right))
        found = search_unit(ids, matrix(lists[0], width), query_ids, matrix(lists[1], width), k)
        rows = [(q, h, -i, s) for q, h, best in zip(query_ids.tolist(), right.column("h").to_pylist(), found) for s, i in best]
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "h", "vec_id", "score"), columns)})

    rows = materialize(quantised(vectors, scale).withColumn("h", F.xxhash64("vec_id", "q")), "topk-vectors")
    queries = rows.where(is_query)
    units = max(1, -(-rows.count() // unit))
    groups = max(1, -(-queries.count() // group))
    left = rows.select("vec_id", "q", F.expr(f"pmod(h, {units})").alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    right = queries.select(
        "vec_id", "q", "h", F.explode(F.expr(f"sequence(0L, {units - 1}L)")).alias("unit"),
        F.expr(f"int(pmod(shiftright(h, 20), {groups}))").alias("grp"),
    )
    found = left.groupBy("unit", "grp").cogroup(right.groupBy("unit", "grp")).applyInArrow(
        search, "query_id long, h long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
