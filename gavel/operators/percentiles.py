"""Exact percentiles per group without collecting or sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16  # bits of one radix digit
LEVELS = (48, 32, 16)  # bits right of the prefix after each pass


def value_cells(df: DataFrame, keys: Sequence[str], value: str = "latency_ms") -> DataFrame:
    """(keys, value, n): the mergeable form of the distribution, combined map-side."""
    present = df.filter(F.col(value).isNotNull())
    return present.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge_value_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def with_ordered_bits(cells: DataFrame) -> DataFrame:
    """Adds `bits`, a long that orders like the double `value`: the 64 bits, reversed below zero."""
    raw = F.java_method(
        F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col("value").cast("double")
    ).cast("bigint")
    # A step of its own: the bits are looked at twice.
    staged = cells.withColumn("__raw", raw)
    flipped = F.col("__raw").bitwiseXOR(F.lit((1 << 63) - 1))
    return staged.withColumn("bits", F.when(F.col("__raw") < 0, flipped).otherwise(F.col("__raw"))).drop("__raw")


def _wanted(total: Column, fractions: dict[str, float]) -> Column:
    """Structs of name, lower and upper position, and the upper one's weight."""
    positions = {name: (total - 1) * F.lit(f) for name, f in fractions.items()}
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.floor(position).alias("lower"),
                F.ceil(position).alias("upper"),
                (position - F.floor(position)).alias("weight"),
            )
            for name, position in positions.items()
        ]
    )


def _holding(wanted: Column, first: Column, last: Column) -> Column:
    """Those of `wanted` with a position between two, both included."""
    return F.filter(
        wanted, lambda w: w["lower"].between(first, last) | w["upper"].between(first, last)
    )


def wanted_ranges(rows: DataFrame, fractions: dict[str, float], level: int) -> DataFrame:
    """(__group, prefix, before, total) of the ranges that hold a wanted position.

    `rows` are (__group, bits, n). A range is all values with the same bits left
    of `LEVELS[level]`; `before` is the number of rows of the group below it. One
    pass a level: the ranges of the level above are counted by their next digit,
    2 ** DIGIT counts a range at most, combined map-side.
    """
    prefix = F.shiftright("bits", LEVELS[level])
    if level == 0:
        counts = rows.groupBy("__group", prefix.alias("prefix")).agg(
            F.sum("n").alias("n"), F.lit(0).cast("bigint").alias("start")
        )
        parent = Window.partitionBy("__group")
        counts = counts.withColumn("total", F.sum("n").over(parent))
    else:
        above = wanted_ranges(rows, fractions, level - 1)
        counts = in_ranges(rows, above, level - 1).groupBy("__group", prefix.alias("prefix")).agg(
            F.sum("n").alias("n"), F.max("before").alias("start"), F.max("total").alias("total")
        )
        parent = Window.partitionBy("__group", F.shiftright("prefix", DIGIT))
    end = F.col("start") + F.sum("n").over(parent.orderBy("prefix"))
    placed = counts.withColumn("__end", end).withColumn("before", F.col("__end") - F.col("n"))
    held = _holding(_wanted(F.col("total"), fractions), F.col("before"), F.col("__end") - 1)
    return placed.filter(F.size(held) > 0).select("__group", "prefix", "before", "total")


def in_ranges(rows: DataFrame, ranges: DataFrame, level: int) -> DataFrame:
    """The rows whose value lies in one of `ranges`, with its columns."""
    return rows.withColumn("prefix", F.shiftright("bits", LEVELS[level])).join(
        ranges, ["__group", "prefix"]
    )


def percentiles(
    cells: DataFrame, keys: Sequence[str], fractions: dict[str, float]
) -> DataFrame:
    """Linear-interpolated percentiles from value cells; one column per fraction.

    Radix selection over the ordered bits of the values: each of three passes
    counts one more digit of 16 bits in the ranges that hold the wanted
    positions, whatever the distribution. What is left to be ordered are
    ranges that agree in 48 bits: 65,536 different values at most, each range by
    itself, so a group in one narrow band is no longer one task's work than a
    wide one.

    All passes read the same shuffled cells, so the wide input is read once: the
    join keys cannot be NULL (the group is a struct), hence no NULL filter is
    inferred that would make the reads differ.
    """
    rows = with_ordered_bits(cells.select(F.struct(*keys).alias("__group"), "value", "n"))
    last = len(LEVELS) - 1
    narrowed = in_ranges(rows, wanted_ranges(rows, fractions, last), last)
    inside = Window.partitionBy("__group", "prefix").orderBy("value")
    placed = narrowed.withColumn(
        "end", F.col("before") + F.sum("n").over(inside) - 1
    ).withColumn("start", F.col("end") - F.col("n") + 1)
    held = _holding(_wanted(F.col("total"), fractions), F.col("start"), F.col("end"))
    picked = placed.select("__group", "value", "start", "end", F.explode(held).alias("w"))

    def at(rank: str) -> Column:
        hit = F.col(f"w.{rank}").between(F.col("start"), F.col("end"))
        return F.max(F.when(hit, F.col("value")))

    points = picked.groupBy("__group", F.col("w.name").alias("name")).agg(
        at("lower").alias("lo"), at("upper").alias("hi"), F.first("w.weight").alias("weight")
    )
    value = F.col("lo") * (F.lit(1.0) - F.col("weight")) + F.col("hi") * F.col("weight")
    wide = points.groupBy("__group").agg(
        *[F.max(F.when(F.col("name") == name, value)).alias(name) for name in fractions]
    )
    return wide.select("__group.*", *fractions)
