"""Projection, grid occupancy, change between periods, polygons and hulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import recode
from tidegrid.operators import grid, hull, polygons, ranks
from tidegrid.plans import surveys
from tidegrid.sources import tables
from tidegrid.workload import views
from tidegrid.workload.registry import query, round_all

STRIP_DEG = 0.1
# Clip rectangle of the hull area, in projected metres (an argument, like the water outline).
# a rectangle to clip each period's hull with: the metres by which it lies east of the first one
MASK_SHIFT = {"pre": 0.0, "crash": 20_000.0, "post": -20_000.0, "total": 10_000.0}
MASKS = {
    period: [(850003.0 + d, 400007.0), (930017.0 + d, 400007.0), (930017.0 + d, 560011.0), (850003.0 + d, 560011.0)]
    for period, d in MASK_SHIFT.items()
}
SHIFT_SQL = "CASE regime WHEN 'pre' THEN 0 WHEN 'crash' THEN 20000 WHEN 'post' THEN -20000 ELSE 10000 END"
BOX = (900_000.0, 350_000.0, 1_150_000.0, 600_000.0)


@query(
    "project_points",
    """
    SELECT DISTINCT lat, lon, round(x, 4) AS x, round(y, 4) AS y FROM points
    """,
    ("points",),
)
def project_points(spark, sf):
    """Distinct coordinates first, projection after."""
    spots = views.surveys(spark, sf).select("lat", "lon").distinct()
    return round_all(grid.project(spots, views.CRS), "x", "y", digits=4)


@query(
    "bbox_crop",
    f"""
    SELECT source, year, count(*) AS n, sum(num_target) AS total FROM points
    WHERE x BETWEEN {BOX[0]} AND {BOX[2]} AND y BETWEEN {BOX[1]} AND {BOX[3]} GROUP BY ALL
    """,
    ("points",),
)
def bbox_crop(spark, sf):
    return grid.crop(views.points(spark, sf), *BOX).groupBy("source", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_target").alias("total")
    )


@query(
    "layer_extent",
    """
    SELECT regime, round(min(x), 3) AS xmin, round(min(y), 3) AS ymin, round(max(x), 3) AS xmax,
           round(max(y), 3) AS ymax FROM regime_points GROUP BY regime
    """,
    ("regime_points",),
)
def layer_extent(spark, sf):
    ext = grid.layer_extent(views.regime_points(spark, sf), "regime")
    return round_all(ext, "xmin", "ymin", "xmax", "ymax", digits=3)


@query(
    "grid_assign",
    """
    SELECT cell_size, ix, iy, count(*) AS n, count(DISTINCT site) AS n_sites
    FROM cells GROUP BY ALL
    """,
    ("cells",),
)
def grid_assign(spark, sf):
    cells = grid.assign_cells(views.points(spark, sf), views.GRID, views.CELL_SIZES)
    return cells.groupBy("cell_size", "ix", "iy").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("site").alias("n_sites")
    )


def present_cells(spark, sf):
    present = views.regime_points(spark, sf).where(F.col("num_target") > 0)
    return grid.assign_cells(present, views.GRID, views.CELL_SIZES)


@query(
    "grid_occupied_cells",
    "SELECT DISTINCT regime, cell_size, ix, iy FROM cells WHERE num_target > 0",
    ("cells",),
)
def grid_occupied_cells(spark, sf):
    return grid.occupied_cells(present_cells(spark, sf), "regime")


@query(
    "occupancy_area",
    """
    SELECT regime, cell_size, n_cells, round(n_cells * (cell_size / 1000) * (cell_size / 1000), 6) AS area_km2
    FROM (SELECT regime, cell_size, count(*) AS n_cells FROM (
            SELECT DISTINCT regime, cell_size, ix, iy FROM cells WHERE num_target > 0
            UNION ALL SELECT DISTINCT 'total', cell_size, ix, iy FROM cells WHERE num_target > 0)
          GROUP BY regime, cell_size)
    """,
    ("cells",),
)
def occupancy_area(spark, sf):
    labels = [label for label, _, _ in views.REGIMES]
    return round_all(grid.occupancy_by_regime(present_cells(spark, sf), labels), "area_km2")


@query(
    "grid_cell_median",
    """
    SELECT cell_size, ix, iy, regime, median(median_count) AS median_count, count(*) AS n
    FROM site_year_cells GROUP BY cell_size, ix, iy, regime
    """,
    ("site_year_cells",),
)
def grid_cell_median(spark, sf):
    return views.site_year_cells(spark, sf).groupBy("cell_size", "ix", "iy", "regime").agg(
        F.median("median_count").alias("median_count"), F.count(F.lit(1)).alias("n")
    )


@query(
    "grid_cell_presence",
    """
    SELECT cell_size, ix, iy, regime, max(presence) AS presence, count(*) AS n
    FROM site_year_cells GROUP BY cell_size, ix, iy, regime
    """,
    ("site_year_cells",),
)
def grid_cell_presence(spark, sf):
    return views.site_year_cells(spark, sf).groupBy("cell_size", "ix", "iy", "regime").agg(
        F.max("presence").alias("presence"), F.count(F.lit(1)).alias("n")
    )


def changes(spark, sf):
    return grid.median_change(views.site_year_cells(spark, sf), "median_count", "pre", "post")


@query(
    "grid_change_median",
    "SELECT cell_size, ix, iy, before, after, change FROM median_change",
    ("median_change",),
)
def grid_change_median(spark, sf):
    return changes(spark, sf).drop("pct_change")


@query(
    "grid_pct_change",
    "SELECT cell_size, ix, iy, change, round(pct_change, 6) AS pct_change FROM median_change",
    ("median_change",),
)
def grid_pct_change(spark, sf):
    return round_all(changes(spark, sf), "pct_change").drop("before", "after")


@query(
    "grid_multiscale",
    """
    SELECT cell_size, count(*) AS n_cells, count(*) FILTER (WHERE change > 0) AS gains,
           count(*) FILTER (WHERE change < 0) AS losses, round(avg(pct_change), 6) AS mean_pct
    FROM median_change GROUP BY cell_size
    """,
    ("median_change",),
)
def grid_multiscale(spark, sf):
    return round_all(
        changes(spark, sf).groupBy("cell_size").agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.count_if(F.col("change") > 0).alias("gains"),
            F.count_if(F.col("change") < 0).alias("losses"),
            F.avg("pct_change").alias("mean_pct"),
        ),
        "mean_pct",
    )


@query(
    "presence_change_counts",
    """
    SELECT cell_size, change_presence, count(*) AS n_cells,
           CASE change_presence WHEN -1 THEN 'loss of presence' WHEN 0 THEN 'no change'
                WHEN 1 THEN 'gain of presence' END AS label
    FROM presence_change GROUP BY ALL
    """,
    ("presence_change",),
)
def presence_change_counts(spark, sf):
    return grid.presence_change_counts(
        grid.presence_change(views.site_year_cells(spark, sf), "pre", "post")
    )


@query(
    "histogram_bins",
    """
    SELECT cell_size, least(CAST(floor((pct_change - lo) / ((hi - lo) / 20)) AS BIGINT), 19) AS bin, count(*) AS n
    FROM median_change, (SELECT min(pct_change) AS lo, max(pct_change) AS hi FROM median_change)
    GROUP BY ALL
    """,
    ("median_change",),
)
def histogram_bins(spark, sf):
    df = changes(spark, sf)
    ends = df.agg(F.struct(F.min("pct_change").alias("lo"), F.max("pct_change").alias("hi")).alias("s"))
    ends = ends.scalar()
    return ranks.histogram(df, ["cell_size"], "pct_change", 20, ends["lo"], ends["hi"])


# --- polygons -----------------------------------------------------------------------------

EDGES_SQL = """
edges AS (
  SELECT poly_id, seq, x AS x1, y AS y1, lead(x, 1, first_x) OVER w AS x2, lead(y, 1, first_y) OVER w AS y2
  FROM (SELECT *, first(x) OVER v AS first_x, first(y) OVER v AS first_y FROM vertices
        WINDOW v AS (PARTITION BY poly_id ORDER BY seq))
  WINDOW w AS (PARTITION BY poly_id ORDER BY seq))
"""


@query(
    "polygon_edges",
    f"""
    WITH {EDGES_SQL}
    SELECT poly_id, seq, round(x1, 6) + 0e0 AS x1, round(y1, 6) + 0e0 AS y1,
           round(x2, 6) + 0e0 AS x2, round(y2, 6) + 0e0 AS y2 FROM edges
    """,
    ("vertices",),
)
def polygon_edges(spark, sf):
    edges = polygons.ring_edges(views.vertices(spark, sf), ["poly_id"], "seq", "x", "y")
    return round_all(edges, "x1", "y1", "x2", "y2")


@query(
    "polygon_area",
    f"""
    WITH {EDGES_SQL}
    SELECT poly_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2 / 1e6, 6) AS area, count(*) AS n_edges
    FROM edges GROUP BY poly_id
    """,
    ("vertices",),
)
def polygon_area(spark, sf):
    edges = polygons.ring_edges(views.vertices(spark, sf), ["poly_id"], "seq", "x", "y")
    return round_all(polygons.ring_area(edges, ["poly_id"], unit=1e6), "area")


WATER_SQL = "water AS (SELECT * FROM (VALUES {}) v(x1, y1, x2, y2))".format(
    ", ".join(
        "({!r}::DOUBLE, {!r}::DOUBLE, {!r}::DOUBLE, {!r}::DOUBLE)".format(
            *views.WATER["water"][i], *views.WATER["water"][(i + 1) % 6]
        )
        for i in range(6)
    )
)
INSIDE_SQL = f"""
{WATER_SQL},
spots AS (SELECT DISTINCT lat, lon FROM surveys WHERE lat IS NOT NULL),
inside AS (
  SELECT lat, lon FROM spots, water
  WHERE (y1 > lat) <> (y2 > lat) AND lon < x1 + (x2 - x1) * (lat - y1) / (y2 - y1)
  GROUP BY lat, lon HAVING count(*) % 2 = 1)
"""


def on_water(spark, df):
    """Rows whose (lon, lat) lies in the water polygon."""
    water = polygons.literal_edges(spark, views.WATER)
    return polygons.keep_inside(df, water, STRIP_DEG, "lon", "lat")


@query(
    "point_in_polygon",
    f"""
    WITH {INSIDE_SQL}
    SELECT s.lat, s.lon, 'water' AS poly_id, count(*) AS n, count(num_target) AS n_counted
    FROM surveys s JOIN inside USING (lat, lon) GROUP BY ALL
    """,
    ("surveys",),
)
def point_in_polygon(spark, sf):
    located = views.surveys(spark, sf).dropna(subset=["lat"])
    return on_water(spark, located).groupBy("lat", "lon", "poly_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("num_target").alias("n_counted")
    )


def hull_sql(spots: str) -> str:
    return f"hull_spots AS ({spots}),{WALK_SQL}"


WALK_SQL = """
walk AS (
  SELECT regime, 0 AS seq, x, y, x AS x0, y AS y0, 1e0 * pi() / 2 AS heading
  FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY x, y) AS rn FROM hull_spots) WHERE rn = 1
  UNION ALL
  SELECT regime, seq, x, y, x0, y0, heading FROM (
    SELECT *, row_number() OVER (PARTITION BY regime ORDER BY dist DESC) AS rn FROM (
      -- smallest left turn from the current heading; of points in line with it, the farthest
      SELECT *, min(turn) OVER (PARTITION BY regime) AS best FROM (
        SELECT w.regime, w.seq + 1 AS seq, s.x, s.y, w.x0, w.y0, atan2(s.y - w.y, s.x - w.x) AS heading,
               (s.x - w.x) ** 2 + (s.y - w.y) ** 2 AS dist,
               (atan2(s.y - w.y, s.x - w.x) - CASE WHEN w.seq = 0 THEN -pi() / 2 ELSE w.heading END + 4 * pi() + 1e-9)
                 % (2 * pi()) AS turn
        FROM walk w JOIN hull_spots s ON s.regime = w.regime AND (s.x <> w.x OR s.y <> w.y)))
    WHERE turn <= best + 1e-9)
  WHERE rn = 1 AND (x <> x0 OR y <> y0)),
ring AS (SELECT regime, seq, x, y FROM walk)
"""
HULL_SQL = hull_sql("SELECT DISTINCT regime, x, y FROM regime_points")


def hull_rings(spark, sf):
    """Sites are surveyed again and again, so coordinates are made distinct before projection."""
    regime = recode.regime_of("year", views.REGIMES).alias("regime")
    spots = views.surveys(spark, sf).select(regime, "lat", "lon").distinct()
    return hull.convex_hull(grid.project(spots, views.CRS), "regime")


@query(
    "convex_hull_eoo",
    f"""
    WITH RECURSIVE {HULL_SQL}
    SELECT regime, CAST(seq AS INTEGER) AS seq, round(x, 3) AS x, round(y, 3) AS y FROM ring
    """,
    ("regime_points",),
)
def convex_hull_eoo(spark, sf):
    return round_all(hull_rings(spark, sf), "x", "y", digits=3)


SWEEP_M = 50_000.0
ROWS_SQL = f"""
hull_edges AS (
  SELECT regime, x AS x1, y AS y1, lead(x, 1, fx) OVER w AS x2, lead(y, 1, fy) OVER w AS y2
  FROM (SELECT *, first(x) OVER v AS fx, first(y) OVER v AS fy FROM ring WINDOW v AS (PARTITION BY regime ORDER BY seq))
  WINDOW w AS (PARTITION BY regime ORDER BY seq)),
box AS (SELECT DISTINCT regime, 850003e0 + {SHIFT_SQL} AS xa, 930017e0 + {SHIFT_SQL} AS xb, 400007e0 AS ya, 560011e0 AS yb FROM hull_edges),
heights AS (
  SELECT regime, y FROM (
    SELECT regime, y1 AS y FROM hull_edges UNION SELECT regime, ya FROM box UNION SELECT regime, yb FROM box
    UNION SELECT regime, y1 + (y2 - y1) * (xa - x1) / (x2 - x1) FROM hull_edges JOIN box USING (regime) WHERE (x1 < xa) <> (x2 < xa)
    UNION SELECT regime, y1 + (y2 - y1) * (xb - x1) / (x2 - x1) FROM hull_edges JOIN box USING (regime) WHERE (x1 < xb) <> (x2 < xb))
  JOIN box USING (regime) WHERE y BETWEEN ya AND yb),
levels AS (SELECT * FROM (SELECT regime, y AS low, lead(y) OVER (PARTITION BY regime ORDER BY y) AS top FROM heights) WHERE top IS NOT NULL),
widths AS (
  SELECT l.regime, low, top, min(x1 + (x2 - x1) * (low - y1) / (y2 - y1)) AS l0, max(x1 + (x2 - x1) * (low - y1) / (y2 - y1)) AS r0,
         min(x1 + (x2 - x1) * (top - y1) / (y2 - y1)) AS l1, max(x1 + (x2 - x1) * (top - y1) / (y2 - y1)) AS r1
  FROM levels l JOIN hull_edges e ON e.regime = l.regime AND y1 <> y2 AND least(y1, y2) <= low AND greatest(y1, y2) >= top GROUP BY ALL),
masked AS (
  SELECT regime, sum((greatest(0, least(r0, xb) - greatest(l0, xa)) + greatest(0, least(r1, xb) - greatest(l1, xa))) / 2 * (top - low)) / 1e6 AS km2
  FROM widths JOIN box USING (regime) GROUP BY regime),
hulls AS (SELECT regime, abs(sum(x1 * y2 - x2 * y1)) / 2 / 1e6 AS hull_km2 FROM hull_edges GROUP BY regime)
"""


@query(
    "eoo_masked_area",
    f"""
    WITH RECURSIVE {HULL_SQL}, {ROWS_SQL}
    SELECT regime, round(hull_km2 - coalesce(km2, 0), 3) AS area_km2, round(hull_km2, 3) AS hull_km2 FROM hulls LEFT JOIN masked USING (regime)
    """,
    ("regime_points",),
)
def eoo_masked_area(spark, sf):
    """Hull area by regime, less what the period's mask covers of it."""
    ring = hull_rings(spark, sf)
    return round_all(masked_area(spark, ring, "regime"), "area_km2", "hull_km2", digits=3)


def masked_area(spark, ring, key):
    edges = tables.materialise(polygons.ring_edges(ring, [key], "seq", "x", "y"))
    masks = polygons.literal_edges(spark, MASKS).withColumn(key, F.col("poly_id"))
    masks = masks.withColumn("poly_id", F.concat(F.lit("mask "), "poly_id"))
    left = polygons.area_outside(edges.withColumn("poly_id", F.lit("hull")), masks, key, SWEEP_M)
    whole = polygons.ring_area(edges, [key], unit=1e6).select(key, F.col("area").alias("hull_km2"))
    return whole.join(left.select(key, (F.col("area") / 1e6).alias("area_km2")), key, "left").withColumn("area_km2", F.coalesce("area_km2", F.lit(0.0)))


# --- catches ------------------------------------------------------------------------------


@query(
    "bycatch_union",
    """
    SELECT haul, concat(fishery, '_catch') AS source, year, round(lat_deg + lat_min / 60, 9) AS lat,
           round(CASE WHEN fishery IN ('crab', 'prawn') THEN lon_deg + lon_min / 60
                      ELSE -(lon_deg + lon_min / 60) END, 9) AS lon,
           1 AS presence,
           round(CASE WHEN fishery IN ('crab', 'prawn') AND depth_unit = 'F' THEN max_depth / 3.28084e0
                      ELSE max_depth END, 9) AS depth
    FROM catches WHERE species_code = 'TGT' AND (fishery <> 'longline' OR catch_count > 0)
    """,
    ("catches",),
)
def bycatch_union(spark, sf):
    df = surveys.bycatch_presence(views.catches(spark, sf), "TGT")
    return round_all(df, "lat", "lon", "depth", digits=9)
