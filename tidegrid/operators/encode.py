"""Covariates, ids and year indices for the models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegrid.functions.recode import regime_of
from tidegrid.operators.lookup import join_null_safe


def zscore_pooled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add (x - mean) / sd over the whole table; ``columns`` maps output to input name.

    The statistics are one row, used as a scalar subquery: no join and no window.  A constant
    column gives NULL.
    """
    stats = df.agg(
        F.struct(
            *[
                F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(out)
                for out, c in columns.items()
            ]
        ).alias("s")
    ).scalar()
    return df.withColumns(
        {
            out: F.try_divide(F.col(c) - stats[out]["mean"], stats[out]["sd"])
            for out, c in columns.items()
        }
    )


def zscore_by(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """The same per dataset, by a join with one row of statistics per dataset; NULL is a dataset."""
    aggs = []
    for out, c in columns.items():
        aggs += [F.avg(c).alias(f"__m_{out}"), F.stddev_samp(c).alias(f"__s_{out}")]
    stats = df.groupBy(key).agg(*aggs)
    scaled = {
        out: F.try_divide(F.col(c) - F.col(f"__m_{out}"), F.col(f"__s_{out}"))
        for out, c in columns.items()
    }
    drop = [f"__{t}_{out}" for out in columns for t in ("m", "s")]
    return join_null_safe(df, stats, [key], "left").withColumns(scaled).drop(*drop)


def effort_design(df: DataFrame, time: str = "time", area: str = "area") -> DataFrame:
    """Scale both effort metrics over all rows, use area where known and time elsewhere, drop
    rows with neither, and zero-fill the metric that is not used.

    ``effort_type`` is 0 for area and 1 for time.
    """
    scaled = zscore_pooled(df, {"scaled_time": time, "scaled_area": area})
    has_area = F.col(area).isNotNull()
    return (
        scaled.withColumns(
            {
                "scaled_effort": F.when(has_area, F.col("scaled_area")).otherwise(F.col("scaled_time")),
                "effort_type": F.when(has_area, 0).otherwise(1),
            }
        )
        .where(F.col("scaled_effort").isNotNull())
        .withColumns(
            {
                "time_term": F.when(F.col(time).isNull(), 0.0).otherwise(F.col("scaled_time")),
                "area_term": F.when(F.col(area).isNull(), 0.0).otherwise(F.col("scaled_area")),
            }
        )
    )


def effort_summary(df: DataFrame, key: str, effort: Column) -> DataFrame:
    return (
        df.groupBy(key)
        .agg(F.avg(effort).alias("mean"), F.stddev_samp(effort).alias("sd"), F.count(effort).alias("n"))
    )


def year_index(df: DataFrame, keys: list[str], base_year: int) -> DataFrame:
    """Sampled years per dataset as positions on the full time span (base year + 1 is 1)."""
    return df.select(*keys, "year").distinct().withColumn("tt", F.col("year") - base_year)


def year_spine(spark, first: int, last: int) -> DataFrame:
    """One row per year; its length is fixed by the arguments."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def regime_by_year(df: DataFrame, regimes, first: int, last: int) -> DataFrame:
    """Every year of the span with its regime code and whether it was surveyed."""
    surveyed = df.select("year").distinct().withColumn("surveyed", F.lit(1))
    return (
        year_spine(df.sparkSession, first, last)
        .join(surveyed, "year", "left")
        .withColumns(
            {"regime": regime_of("year", regimes), "surveyed": F.coalesce("surveyed", F.lit(0))}
        )
    )


def isolated_years(df: DataFrame, keys: list[str]) -> DataFrame:
    """Flag sampled years with no sampled neighbour year (a line cannot be drawn through them).

    The window runs over distinct years, not over surveys.
    """
    years = df.select(*keys, "year").distinct()
    w = Window.partitionBy(*keys).orderBy("year")
    gap_before = F.coalesce(F.col("year") - F.lag("year").over(w), F.lit(0)) != 1
    gap_after = F.coalesce(F.lead("year").over(w) - F.col("year"), F.lit(0)) != 1
    return years.withColumn("isolated", (gap_before & gap_after).cast("int"))
