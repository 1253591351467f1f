"""Joins that treat NULL as a key.

Lookup tables are joined like any other table: adaptive execution sends a side to all tasks once its real
size allows it, and splits skewed partitions of the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegrid.functions.missing import same_key


def join_null_safe(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | list[tuple[str, str]],
    how: str = "inner",
) -> DataFrame:
    """Equi-join in which NULL keys match; one coalesced copy of each key is kept.

    ``keys`` are names or (left, right) pairs; the output key carries the left name.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    # renaming is a projection, under which a broadcast hint of the right side stays in force
    tagged = right.withColumnsRenamed({r: f"__r_{r}" for _, r in pairs})
    cond = same_key([(l, f"__r_{r}") for l, r in pairs])
    joined = left.join(tagged, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "right"):
        joined = joined.withColumns(
            {l: F.coalesce(F.col(l), F.col(f"__r_{r}")) for l, r in pairs}
        )
    return joined.drop(*[f"__r_{r}" for _, r in pairs])


def exclude(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the exclusion table (keys, not row numbers, so it is stable)."""
    return join_null_safe(df, listed.select(*keys).distinct(), keys, "left_anti")
