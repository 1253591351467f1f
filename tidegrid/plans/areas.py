"""Extent, occupancy and change chains on projected points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegrid.functions.coords import Albers, GridSpec
from tidegrid.functions.recode import regime_of
from tidegrid.operators import grid, hull, lookup, polygons


def clean_points(
    df: DataFrame, crs: Albers, water: DataFrame, strip: float, regimes, listed: DataFrame | None,
    keys: list[str],
) -> DataFrame:
    """Located rows on water, without the excluded records, projected and labelled by period."""
    located = polygons.keep_inside(df.dropna(subset=["lat", "lon"]), water, strip, "lon", "lat")
    if listed is not None:
        located = lookup.exclude(located, listed, keys)
    return grid.project(located, crs).withColumn("regime", regime_of("year", regimes))


def with_total(df: DataFrame, total: str = "total") -> DataFrame:
    """Each row under its period and again under the total; rows between periods only there."""
    labels = F.filter(F.array("regime", F.lit(total)), lambda r: r.isNotNull())
    return df.withColumn("regime", F.explode(labels))


def extent_and_occupancy(
    present: DataFrame, spec: GridSpec, cell: float, labels: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(hull rings, occupied area) by period and in total, from presence points."""
    spots = with_total(present.select("regime", "x", "y").distinct())
    rings = hull.convex_hull(spots, "regime")
    cells = grid.assign_cells(present, spec, [cell])
    return rings, grid.occupancy_by_regime(cells, labels)


def change_summary(cells: DataFrame, value: str, before: str, after: str) -> DataFrame:
    """Per resolution: compared cells, gains, losses, ties and the mean percent change."""
    change = F.col("change")
    return grid.median_change(cells, value, before, after).groupBy("cell_size").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(change > 0).alias("gains"),
        F.count_if(change < 0).alias("losses"),
        F.count_if(change == 0).alias("ties"),
        F.avg("pct_change").alias("mean_pct"),
    )
