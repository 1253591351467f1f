"""Index of a state by year beside the raw survey trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegrid.operators import encode, posterior, rollup


def index_with_effort(long: DataFrame, surveys: DataFrame, first: int, last: int, series: list[str]) -> DataFrame:
    """Annual index on the full span, with surveys per year and the raw sighting frequency."""
    index = posterior.annual_index(long, ["series", "year"])
    spine = encode.year_spine(surveys.sparkSession, first, last)
    raw = rollup.sighting_frequency(surveys, ["year"]).withColumnsRenamed(
        {"n": "n_surveys", "mean_presence": "raw_presence"}
    )
    out = posterior.on_spine(index, spine, series).join(raw, "year", "left")
    return out.withColumn("n_surveys", F.coalesce("n_surveys", F.lit(0)))
