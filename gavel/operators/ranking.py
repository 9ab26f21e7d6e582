"""Order-dependent operators that stay distributed when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.text import seeded_hash
from gavel.schemas import require


def bucket_rank(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    rank: str = "rank",
    total: str = "group_size",
) -> DataFrame:
    """Exact 1-based row number per group without sorting a group in one task.

    `bucket` must grow with `order` and never be NULL. Bucket sizes (a small pre-aggregated table)
    give every bucket its starting rank, then each (group, bucket) sorts alone.
    """
    # As a struct the group is never NULL itself, so a NULL key is a group like any other.
    group_key = F.struct(*keys) if keys else F.lit(0)
    tagged = df.withColumns({"__group": group_key, "__bucket": bucket})
    parts = ["__group", "__bucket"]
    sizes = tagged.groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy("__group")
    offsets = sizes.select(
        *parts,
        (F.sum("__n").over(group.orderBy("__bucket")) - F.col("__n")).alias("__offset"),
        F.sum("__n").over(group).alias(total),
    )
    # Join and window share the (group, bucket) partitioning: one shuffle of the rows.
    within = Window.partitionBy(*parts).orderBy(*order)
    return (
        tagged.join(offsets, parts, "inner")
        .withColumn(rank, F.col("__offset") + F.row_number().over(within))
        .drop(*parts, "__offset")
    )


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_column: str,
    seed: int | str = 42,
    hex_digits: int = 3,
) -> DataFrame:
    """Rank in seeded hash order: a deterministic shuffle. Adds `rank`, `group_size`.

    Hash prefixes make even buckets whatever the group sizes; more digits mean
    more and smaller buckets.
    """
    hashed = df.withColumn("__h", seeded_hash(seed, F.col(id_column)))
    ranked = bucket_rank(
        hashed,
        keys,
        F.coalesce(F.substring("__h", 1, hex_digits), F.lit("")),
        [F.col("__h"), F.col(id_column)],
    )
    return ranked.drop("__h")


def kfold(
    df: DataFrame, folds: int, keys: Sequence[str] = (), id_column: str = "id", seed: int = 42
) -> DataFrame:
    """Adds `fold` (0-based): near-equal chunks of a seeded shuffle, larger ones first."""
    if folds < 2:
        raise ValueError(f"folds must be >= 2, got {folds}")
    ranked = hash_rank(df, keys, id_column, seed)
    ranked = require(ranked, F.col("group_size") >= folds, f"fewer items than {folds} folds")
    base = F.floor(F.col("group_size") / folds)
    extra = F.col("group_size") % folds
    head = extra * (base + 1)
    position = F.col("rank") - 1
    fold = F.when(position < head, F.floor(position / (base + 1))).otherwise(
        extra + F.floor((position - head) / base)
    )
    return ranked.withColumn("fold", fold.cast("int")).drop("rank", "group_size")


def fold_splits(df: DataFrame, folds: int) -> DataFrame:
    """Every item once per fold: `split` is val in its own fold and train in the others."""
    run = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("run_fold")
    return df.select("*", run).withColumn(
        "split", F.when(F.col("fold") == F.col("run_fold"), "val").otherwise("train")
    )


def holdout(
    df: DataFrame,
    fraction: float,
    keys: Sequence[str] = (),
    id_column: str = "id",
    seed: int = 42,
    keep_single: bool = True,
) -> DataFrame:
    """Adds `split`: max(1, floor(n * fraction)) validation rows per group, the rest train.

    With `keep_single`, a group of one row and a fraction <= 0 hold nothing out.
    """
    if keep_single and fraction <= 0:
        return df.withColumn("split", F.lit("train"))
    ranked = hash_rank(df, keys, id_column, seed)
    held = F.greatest(F.lit(1), F.floor(F.col("group_size") * fraction))
    chosen = F.col("rank") <= held
    if keep_single:
        chosen = chosen & (F.col("group_size") > 1)
    return ranked.withColumn("split", F.when(chosen, "val").otherwise("train")).drop(
        "rank", "group_size"
    )


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Column,
    salts: int = 64,
    limit: Column | None = None,
) -> DataFrame:
    """First `n` rows per group; a huge group is cut down in `salts` parts first.

    `spread` is any column that differs between rows of a group. `limit` may
    lower the count per row group (at most `n`).
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    kept = salted.withColumn("__rn", F.row_number().over(part)).filter(F.col("__rn") <= n)
    kept = kept.withColumn("__rn", F.row_number().over(whole)).filter(F.col("__rn") <= n)
    if limit is not None:
        kept = kept.filter(F.col("__rn") <= limit)
    return kept.drop("__rn", "__salt")


def limit_per_dataset(
    df: DataFrame, limit: int, order: str = "row_index", key: str = "dataset"
) -> DataFrame:
    """First `limit` rows of every dataset in source order."""
    return top_per_group(df, [key], [F.col(order)], limit, F.col(order))


def smoke_limit(
    df: DataFrame,
    limits: dict[str, int | None],
    smoke: int,
    order: str = "row_index",
    key: str = "dataset",
) -> DataFrame:
    """First min(configured limit, smoke limit) rows of every dataset."""
    chosen = F.lit(smoke)
    for name, value in limits.items():
        if value is not None and value < smoke:
            chosen = F.when(F.col(key) == name, value).otherwise(chosen)
    return top_per_group(df, [key], [F.col(order)], smoke, F.col(order), limit=chosen)


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with the smallest `order`. Combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.col(order))
    return df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, "__row.*").select(df.columns)


def seeded_sample(
    df: DataFrame, key: str, n: int, order: str, seed: int | str = 42
) -> DataFrame:
    """Drop repeated keys (first in source order stays), then `n` rows in hash order."""
    unique = first_wins(df, [key], order)
    return (
        unique.withColumn("__h", seeded_hash(seed, F.col(key)))
        .orderBy("__h")
        .limit(n)
        .drop("__h")
    )


def score_rank(df: DataFrame, score: str, tie: str, buckets: int = 4096) -> DataFrame:
    """1-based rank by a 0-1 score, highest first, NULL as zero and ties by `tie`."""
    value = F.coalesce(F.col(score), F.lit(0.0))
    bucket = F.coalesce(F.floor((F.lit(1.0) - value) * buckets), F.lit(0))
    ranked = bucket_rank(df, [], bucket, [value.desc(), F.col(tie)])
    return ranked.drop("group_size")
