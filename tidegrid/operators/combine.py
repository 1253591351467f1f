"""Union of sources and column bookkeeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union by name; a column that a source lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.drop(*columns_between(df, first, last))


def keep_range(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.select(*columns_between(df, first, last))
