"""One row per key: highest value or first row, as an aggregation.

The minimum of a row struct, ordered columns first, combines on the map side, so each task sends
one row per key into the shuffle however many repeats the key has.  A ``row_number`` window
would send every row of a hot key to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.functions.missing import as_col


def _pick(
    df: DataFrame, keys: list[str], lead: list[Column], order: list[str], extra: dict[str, Column]
) -> DataFrame:
    """First row of each key by ``lead``, then ``order``, then all remaining columns, which makes
    the order total."""
    others = [c for c in order if c not in keys]
    others += [c for c in df.columns if c not in keys and c not in others]
    picked = df.groupBy(*keys).agg(
        F.min(F.struct(*lead, *others)).alias("__row"),
        *[c.alias(name) for name, c in extra.items()],
    )
    columns = [c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]
    return picked.select(*columns, *extra)


def keep_max(
    df: DataFrame,
    keys: list[str],
    value: Column | str,
    tiebreak: list[str],
    count_as: str = "num_surveys",
) -> DataFrame:
    """Row with the highest value of each key, plus how many rows the key had.

    A NULL value loses to any other but survives alone.  NULL is a key of its own.  Ties go to
    the lowest ``tiebreak`` columns (NULL lowest), then to the lowest remaining columns.
    """
    value = as_col(value)
    lead = [value.isNull().alias("__na"), (-value).alias("__v")]
    out = _pick(df, keys, lead, tiebreak, {count_as: F.count(F.lit(1))})
    return out.withColumn("multiple_surveys", (F.col(count_as) > 1).cast("int"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order, all columns kept."""
    return _pick(df, keys, [], order, {})
