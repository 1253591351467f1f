"""Recoding of scores, tags, flags and period labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegrid.functions.missing import as_col, as_number

# Lowest count of each abundance bin.
FIVE_LEVEL_COUNTS = [0, 1, 2, 11, 101]
SEVEN_LEVEL_COUNTS = [0, 1, 11, 26, 51, 101, 1001]

# Abundance score of each tag word.
TAG_WORDS = {
    "none": 0,
    "few": 1,
    "present": 1,
    "some": 2,
    "many": 3,
    "very many": 4,
    "abundant": 5,
    "very abundant": 6,
    "5+": 1,
}
# Fixed values: (above, below, score) for a numeric tag.
TAG_RANGES = [
    (None, 11, 1),
    (10, 26, 2),
    (25, 51, 3),
    (50, 101, 4),
    (100, 1001, 5),
    (1000, None, 6),
]
FEET_PER_METRE = 3.28084


def case_of(arms: list[tuple[Column, Column]]) -> Column:
    """``CASE WHEN`` from (condition, value) pairs; no arm gives NULL."""
    out = None
    for cond, value in arms:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def score_to_count(score: Column | str, low_counts: list[int], first: int = 0) -> Column:
    """Score to the lowest count of its bin; ``first`` is the code of the lowest level."""
    score = as_col(score)
    return case_of([(score == first + i, F.lit(n)) for i, n in enumerate(low_counts)])


def tag_to_score(tag: Column | str) -> Column:
    """Word or number to an ordinal score 0-6.

    Words win over numbers.  A numeric 0 falls in the lowest numeric range and scores 1; only
    the word "none" scores 0.
    """
    tag = as_col(tag)
    num = as_number(tag)
    arms = [(tag == word, F.lit(score)) for word, score in TAG_WORDS.items()]
    for above, below, score in TAG_RANGES:
        cond = F.lit(True)
        if above is not None:
            cond = cond & (num > above)
        if below is not None:
            cond = cond & (num < below)
        arms.append((cond, F.lit(score)))
    return case_of(arms)


def shift_score(seen: Column | str, score: Column | str) -> Column:
    """Absent -> 1, present but not scored -> NULL, else score + 1."""
    seen, score = as_col(seen), as_col(score)
    return F.when(seen == 0, F.lit(1)).otherwise(score + 1)


def presence(count: Column | str) -> Column:
    """1 when the count is positive, else 0 (a NULL count is 0)."""
    return F.when(as_col(count) > 0, 1).otherwise(0)


def present_unless_zero(score: Column | str) -> Column:
    """0 only for a score of exactly zero (a NULL score counts as present)."""
    return F.when(as_col(score) == 0, 0).otherwise(1)


def binary_of(c: Column | str, zero: str, one: str) -> Column:
    c = as_col(c)
    return F.when(c == zero, 0).when(c == one, 1)


def regime_of(year: Column | str, regimes: list[tuple[object, int | None, int | None]]) -> Column:
    """Label of the first (label, lo, hi) period that holds the year; bounds are inclusive."""
    year = as_col(year)
    arms = []
    for label, lo, hi in regimes:
        cond = year.isNotNull()
        if lo is not None:
            cond = cond & (year >= lo)
        if hi is not None:
            cond = cond & (year <= hi)
        arms.append((cond, F.lit(label)))
    return case_of(arms)


def metres(depth: Column | str, unit: Column | str, feet_code: str = "F") -> Column:
    depth = as_col(depth)
    return F.when(as_col(unit) == feet_code, depth / FEET_PER_METRE).otherwise(depth)
