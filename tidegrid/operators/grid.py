"""Grid occupancy and change between two periods.

Cells are integer keys computed per row; "spatial joins" of points to the grid are therefore
group-bys on the cell key, and joining two grids is one conditional aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.functions.coords import Albers, GridSpec
from tidegrid.functions.recode import case_of

CHANGE_LABELS = [(-1, "loss of presence"), (0, "no change"), (1, "gain of presence")]


def project(df: DataFrame, crs: Albers, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Drop rows without coordinates and add projected ``x`` and ``y`` in metres."""
    x, y = crs.xy(lon, lat)
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"x": x, "y": y})


def crop(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    return df.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def layer_extent(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"),
        F.max("x").alias("xmax"), F.max("y").alias("ymax"),
    )


def assign_cells(
    df: DataFrame, grid: GridSpec, sizes: list[float], closed: bool = True
) -> DataFrame:
    """Add ``cell_size``, ``ix``, ``iy`` for every resolution in one pass.

    With ``closed`` a point exactly on a shared edge belongs to every cell that touches it.
    """
    size = F.col("cell_size")
    sized = df.withColumn("cell_size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    if not closed:
        ix, iy = grid.index("x", "y", size)
        return sized.withColumns({"ix": ix, "iy": iy})
    exploded = sized.withColumn("__c", F.explode(grid.cells("x", "y", size)))
    return exploded.select(*df.columns, "cell_size", "__c.ix", "__c.iy")


def occupied_cells(df: DataFrame, *keys: str) -> DataFrame:
    """Cells that hold at least one row."""
    return df.select(*keys, "cell_size", "ix", "iy").distinct()


def occupancy_area(cells: DataFrame, *keys: str) -> DataFrame:
    """Number of occupied cells and their area in square kilometres."""
    side_km = F.col("cell_size") / 1000.0
    return (
        cells.groupBy(*keys, "cell_size")
        .agg(F.count(F.lit(1)).alias("n_cells"))
        .withColumn("area_km2", F.col("n_cells") * side_km * side_km)
    )


def occupancy_by_regime(df: DataFrame, regimes: list[str], total: str = "total") -> DataFrame:
    """Occupied area per period and overall, from one distinct over the cells.

    Each cell carries one flag per period, so the overall count needs no second pass.
    """
    flags = [F.max((F.col("regime") == r).cast("int")).alias(f"__{r}") for r in regimes]
    per_cell = df.groupBy("cell_size", "ix", "iy").agg(*flags)
    names = F.filter(
        F.array(*[F.when(F.col(f"__{r}") == 1, F.lit(r)) for r in regimes], F.lit(total)),
        lambda r: r.isNotNull(),
    )
    cells = per_cell.select("cell_size", "ix", "iy", F.explode(names).alias("regime"))
    return occupancy_area(cells, "regime")


def cell_by_regime(
    df: DataFrame, value: str, summary, before: str, after: str
) -> DataFrame:
    """One row per cell with the summary of each period side by side."""
    pick = lambda regime: summary(F.when(F.col("regime") == regime, F.col(value)))
    return df.groupBy("cell_size", "ix", "iy").agg(
        pick(before).alias("before"), pick(after).alias("after")
    )


def median_change(df: DataFrame, value: str, before: str, after: str) -> DataFrame:
    """Change in the cell median for cells with a value in both periods, and the percent change.

    A gain is divided by the later value and a loss by the earlier one, so the percentage stays
    within [-100, 100].  Medians are exact; the buffer is one entry per distinct value of the
    half-integer site medians in a cell.
    """
    both = cell_by_regime(df, value, F.median, before, after).withColumn(
        "change", F.col("after") - F.col("before")
    )
    pct = case_of(
        [
            (F.col("change") > 0, F.try_divide("change", "after") * 100.0),
            (F.col("change") < 0, F.try_divide("change", "before") * 100.0),
            (F.col("change") == 0, F.lit(0.0)),
        ]
    )
    return both.where(F.col("change").isNotNull()).withColumn("pct_change", pct)


def presence_change(df: DataFrame, before: str, after: str) -> DataFrame:
    """-1, 0 or +1 per cell from the maximum presence of each period."""
    both = cell_by_regime(df, "presence", F.max, before, after)
    change = (F.col("after") - F.col("before")).alias("change_presence")
    return both.select("*", change).where(F.col("change_presence").isNotNull())


def change_label(change: Column) -> Column:
    return case_of([(change == code, F.lit(text)) for code, text in CHANGE_LABELS])


def presence_change_counts(changes: DataFrame) -> DataFrame:
    return (
        changes.groupBy("cell_size", "change_presence")
        .agg(F.count(F.lit(1)).alias("n_cells"))
        .withColumn("label", change_label(F.col("change_presence")))
    )
