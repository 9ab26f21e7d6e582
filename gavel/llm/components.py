"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.session import checked_broadcast, materialize, release

BROADCAST_ROWS = 300_000  # of 16 bytes


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the smallest b of every a, written, so that a join with it can split a hot a."""
    return materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "components-least")


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node of distinct edges (larger, smaller) has either one smaller node or only larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("all"))
    return nodes.where((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("all") == 0))).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of edges (a, b), a and b long, but the smallest of its component, which is root.

    Large-star and small-star rounds: each node's larger neighbours, then its
    smaller ones, move to the smallest neighbour, until only stars are left. Every
    step is written to the shared folder, so a lost executor costs one step, and
    only a yes or no reaches the driver. Joins are between written tables, the
    smallest neighbours broadcast up to BROADCAST_ROWS of them, so that a node of
    very many edges is split among tasks. Self-loops and repeated edges do no
    harm; a node without edges is not listed; no edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, used = materialize(now, "components"), []
    while not _only_stars(now):
        least = _least(now.union(now.select("b", "a")))
        to = checked_broadcast(least.withColumnRenamed("a", "b"), BROADCAST_ROWS)
        large = materialize(now.join(to, "b").select("a", F.least("b", "m").alias("b")), "components-large")
        smaller = _least(large)
        small = large.join(checked_broadcast(smaller, BROADCAST_ROWS), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        used += [now, least, large, smaller]
        now = materialize(small.union(smaller.select("a", "m")).where("a <> b").distinct(), "components")
    release(spark, *used)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    stars._scratch_path = now._scratch_path
    return stars


def grown(stars: DataFrame, links: DataFrame) -> DataFrame:
    """The components of what `stars` (node, root) already joins and of new links (a, b).

    Links are between roots from the start, so the rounds work on the new links
    only; without a link between two components the stars stay as they are.
    """
    for end in ("a", "b"):
        part = checked_broadcast(stars.select(F.col("node").alias(end), "root"), BROADCAST_ROWS)
        links = links.join(part, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    new = connected_components(links)
    moved = checked_broadcast(new.select(F.col("node").alias("root"), F.col("root").alias("to")), BROADCAST_ROWS)
    old = stars.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = materialize(old.union(new), "components-grown")
    release(links.sparkSession, new)
    return out

