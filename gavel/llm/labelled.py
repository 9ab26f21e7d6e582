"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.session import release

THRESHOLD = 0.7  # a document with this score or more is predicted 1


def in_fold(fold: tuple[int, int], key: str = "doc_id") -> Column:
    """crc32 of the id as text leaves remainder fold[1] modulo fold[0]; a null id counts as the empty text."""
    modulus, remainder = fold
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus == remainder


def sample(docs: DataFrame, labels: DataFrame, column: str, fold: tuple[int, int], per_class: int) -> list[tuple[str, int]]:
    """(text, label) of at most `per_class` documents of each label outside the held-out fold.

    The choice goes by a hash of the id. Null labels, ids and texts teach
    nothing; an id labelled both ways counts as 1; labels other than 0 and 1 are
    left out. The result is bounded by 2 * per_class rows.
    """
    known = (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(fold))
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    )
    order = F.xxhash64("doc_id")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = []
    for label in (0, 1):
        # More ids than rows are wanted, as a label's document may be missing.
        chosen = known.where(F.col("label") == label).orderBy(order).limit(2 * per_class)
        found = texts.join(F.broadcast(chosen), "doc_id").orderBy(order, "text").limit(per_class)
        rows += [(r.text, label) for r in found.select("text").collect()]
    release(docs.sparkSession)  # room for the fit
    return rows


def predicted(score: Column | str, threshold: float = THRESHOLD) -> Column:
    return (F.col(score) if isinstance(score, str) else score).__ge__(threshold).cast("int")
