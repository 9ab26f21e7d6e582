"""Whole rows as one column, so that no column of a user's table meets a name of an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """`__row`, a struct of all columns of `df`, and `more` columns computed from them."""
    return df.select(F.struct(*map(quoted, df.columns)).alias("__row"), *more)


def unpacked(df: DataFrame, *more: Column | str) -> DataFrame:
    return df.select("__row.*", *more)


def text_of(name: str = "text") -> Column:
    return quoted(name).cast("string").alias(name)
