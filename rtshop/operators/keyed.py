"""One row per key, by first or last arrival. The order must be total: rows that tie in it are taken to be equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Spark keeps one row per key and task before the shuffle, so a key with much of the
    data never becomes a large group, and columns nobody asks for are not read."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is first by ``order``. Batch."""
    return _first_row(df, keys, [F.asc(name) for name in order])


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order``. Batch."""
    return _first_row(df, keys, [F.desc(name) for name in order])
