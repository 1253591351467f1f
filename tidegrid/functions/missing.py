"""Missing-value rules that differ from Spark's defaults.

The data model treats NA as a value: it is a valid group key, it matches itself in joins, it
prints as "NA" in composite keys, and plain ``mean``/``max`` over a group with an NA are NA.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_text(c: Column | str) -> Column:
    """Text of a value, with NULL spelled "NA"."""
    return F.coalesce(as_col(c).cast("string"), F.lit("NA"))


def paste(*cols: Column | str, sep: str = "_") -> Column:
    """Composite key.  ``concat_ws`` alone would skip NULLs and merge different keys."""
    return F.concat_ws(sep, *[na_text(c) for c in cols])


def strict_avg(c: Column | str) -> Column:
    """Group mean that is NULL as soon as one value of the group is NULL."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def strict_max(c: Column | str) -> Column:
    """Group maximum that is NULL as soon as one value of the group is NULL."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.max(c))


def nan_to_null(c: Column | str) -> Column:
    """Spark counts NaN in averages and sorts it as the maximum; map it out at the source."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def sentinel_to_null(c: Column | str, *sentinels: str) -> Column:
    c = as_col(c)
    return F.when(~c.isin(*sentinels), c)


def as_number(c: Column | str) -> Column:
    """Text to double; anything unreadable becomes NULL (a plain cast raises in ANSI mode)."""
    return as_col(c).try_cast("double")


def matches(c: Column | str, pattern: str) -> Column:
    """Regex test that is FALSE, not NULL, on a NULL input, so it can be negated safely."""
    return F.coalesce(as_col(c).rlike(pattern), F.lit(False))


def same_key(pairs: list[tuple[str, str]]) -> Column:
    """Join condition in which NULL matches NULL; Spark still plans it as an equi-join."""
    return reduce(lambda a, b: a & b, [F.col(lc).eqNullSafe(F.col(rc)) for lc, rc in pairs])
