"""Grouped summaries of survey tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegrid.functions.missing import strict_avg, strict_max


def site_year_rollup(
    df: DataFrame,
    keys: list[str],
    count: str | None,
    presence: str,
    strict_mean: bool = False,
) -> DataFrame:
    """Visits, mean and median count, and presence per site and year.

    NULL coordinates form groups of their own.  ``strict_mean`` gives a NULL mean as soon as
    one count is NULL; the presence maximum is always strict.  The median is the built-in exact
    percentile: its buffer holds one entry per distinct count, not per row, and it combines on
    the map side, so a hot site costs no more than the number of different counts seen there.
    """
    aggs = [F.count(F.lit(1)).alias("num_visits")]
    if count is not None:
        mean = strict_avg(count) if strict_mean else F.avg(count)
        aggs += [mean.alias("mean_count"), F.median(count).alias("median_count")]
    aggs.append(strict_max(presence).alias("presence"))
    return df.groupBy(*keys).agg(*aggs)


def sighting_frequency(df: DataFrame, keys: list[str], presence: str = "presence") -> DataFrame:
    """Mean presence and number of surveys per group."""
    return df.groupBy(*keys).agg(
        strict_avg(presence).alias("mean_presence"), F.count(F.lit(1)).alias("n")
    )


def missingness(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    nulls = F.count_if(F.col(column).isNull())
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        nulls.alias("nas"),
        (nulls / F.count(F.lit(1))).alias("prop_na"),
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def cardinalities(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Row count and number of unique values per column, NULL counted as a value."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("long"))).alias(name)
            for name, c in columns.items()
        ],
    )
