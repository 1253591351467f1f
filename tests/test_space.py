"""Projection, grid, polygons and hulls."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.coords import Albers, GridSpec, parse_degrees_minutes
from tidegrid.operators import grid, hull, polygons


def test_projection_of_known_points(spark):
    df = spark.createDataFrame([(-126.0, 45.0), (-125.149946, 48.949908), (None, None)], "lon double, lat double")
    got = sorted((r["x"], r["y"]) for r in grid.project(df, Albers()).collect())
    assert got[0] == pytest.approx((1_000_000.0, 0.0), abs=1e-6)
    assert got[1] == pytest.approx((1062345.235, 437444.902), abs=1e-3)
    assert len(got) == 2
    assert Albers().n == pytest.approx(0.8093559065590664, rel=1e-14)


def test_projection_keeps_area(spark):
    """A small box has the same area whatever its latitude, up to the ellipsoid's own shape."""
    crs = Albers()
    for lat in (48.0, 54.0):
        d = 0.001
        ring = [(-128.0, lat), (-128.0 + d, lat), (-128.0 + d, lat + d), (-128.0, lat + d)]
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(ring)], "seq int, lon double, lat double")
        pts = grid.project(df, crs).withColumn("g", F.lit(1))
        area = polygons.ring_area(polygons.ring_edges(pts, ["g"], "seq", "x", "y"), ["g"]).first()["area"]
        s = math.sin(math.radians(lat + d / 2))
        meridian = crs.a * (1 - crs.e2) / (1 - crs.e2 * s * s) ** 1.5
        normal = crs.a / math.sqrt(1 - crs.e2 * s * s)
        true = meridian * normal * math.cos(math.radians(lat + d / 2)) * math.radians(d) ** 2
        assert area == pytest.approx(true, rel=1e-6)


def test_degree_minute_text(spark):
    df = spark.createDataFrame([("48 7.3",), ("-123 11.25",), ("NULL",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_degrees_minutes("t")).collect()]
    assert got[:2] == pytest.approx([48 + 7.3 / 60, 123 + 11.25 / 60])
    assert got[2:] == [None, None]


def test_closed_cells(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 10.0, 20.0), (4, 5.0, 10.0)], "id int, x double, y double")
    cells = grid.assign_cells(df, GridSpec(), [10.0])
    got = {}
    for r in cells.collect():
        got.setdefault(r["id"], set()).add((r["ix"], r["iy"]))
    assert got == {1: {(0, 0)}, 2: {(0, 0), (1, 0)}, 3: {(0, 1), (0, 2), (1, 1), (1, 2)}, 4: {(0, 0), (0, 1)}}
    assert grid.assign_cells(df, GridSpec(), [10.0], closed=False).count() == 4


def test_coarse_grids_never_have_more_cells(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.uniform(0, 9e4, 400), "y": rng.uniform(0, 9e4, 400), "regime": "pre"})
    cells = grid.assign_cells(spark.createDataFrame(pdf), GridSpec(), [2000.0, 10000.0])
    area = {(r["regime"], r["cell_size"]): r["n_cells"] for r in grid.occupancy_by_regime(cells, ["pre"]).collect()}
    assert area[("pre", 10000.0)] <= area[("pre", 2000.0)]
    assert area[("pre", 2000.0)] == area[("total", 2000.0)]
    expect = {(math.floor(x / 2000), math.floor(y / 2000)) for x, y in pdf[["x", "y"]].to_numpy()}
    assert area[("pre", 2000.0)] == len(expect)


def test_change_and_percent(spark):
    data = [(1, "pre", 4.0), (1, "post", 1.0), (2, "pre", 1.0), (2, "post", 4.0), (3, "pre", 2.0), (3, "post", 2.0),
            (4, "pre", 9.0), (5, "pre", 0.0), (5, "post", 3.0), (6, "pre", None), (6, "post", 1.0)]
    df = spark.createDataFrame([(10.0, i, 0, r, v) for i, r, v in data], "cell_size double, ix long, iy long, regime string, v double")
    got = {r["ix"]: (r["change"], r["pct_change"]) for r in grid.median_change(df, "v", "pre", "post").collect()}
    assert got == {1: (-3.0, -75.0), 2: (3.0, 75.0), 3: (0.0, 0.0), 5: (3.0, 100.0)}


def star(n, seed):
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    radius = rng.uniform(20, 100, n)
    return np.c_[radius * np.cos(angle), radius * np.sin(angle)]


def inside(ring, x, y):
    hit = False
    for i in range(len(ring)):
        (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % len(ring)]
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            hit = not hit
    return hit


@pytest.mark.parametrize("strip", [3.0, 1000.0])
def test_points_in_polygons_brute_force(spark, strip):
    rings = {"a": star(40, 1), "b": star(9, 2) + 50}
    rng = np.random.default_rng(9)
    pts = rng.uniform(-120, 160, (600, 2))
    pts = np.concatenate([pts, pts[:200]])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y"]))
    edges = polygons.literal_edges(spark, {k: [tuple(p) for p in v] for k, v in rings.items()})
    kept = polygons.keep_inside(df, edges, strip).collect()
    expect = sum(inside(ring, *p) for p in pts for ring in rings.values())
    assert len(kept) == expect
    outside = polygons.keep_outside(df, edges, strip).count()
    assert outside == sum(not any(inside(r, *p) for r in rings.values()) for p in pts)
    # a mask for each period
    periods = df.withColumn("period", F.when(F.col("x") > 0, "a").otherwise("b"))
    of_period = polygons.keep_outside(periods, edges, strip, keys=[("period", "poly_id")]).count()
    assert of_period == sum(not inside(rings["a" if p[0] > 0 else "b"], *p) for p in pts)


def brute_hull(points):
    """Vertices p with an edge p -> q that has every other point on its left."""
    points = np.unique(points, axis=0)
    out = set()
    for p in points:
        d = points - p
        for q in points:
            e = q - p
            if not e.any():
                continue
            cross = e[0] * d[:, 1] - e[1] * d[:, 0]
            on = cross == 0
            if (cross >= 0).all() and ((d[on] @ e) <= (e @ e) * (1 + 1e-12)).all() and ((d[on] @ e) >= 0).all():
                out.add(tuple(p))
    return out


def test_hull_brute_force_and_idempotence(spark):
    rng = np.random.default_rng(13)
    frames = [
        pd.DataFrame({"g": "hot", "x": rng.integers(0, 60, 900), "y": rng.integers(0, 60, 900)}),
        pd.DataFrame({"g": "line", "x": np.arange(30), "y": 2 * np.arange(30)}),
        pd.DataFrame({"g": "dot", "x": [4, 4], "y": [5, 5]}),
        pd.DataFrame({"g": "circle", "x": np.cos(np.arange(200)) * 50, "y": np.sin(np.arange(200)) * 50}),
    ]
    pdf = pd.concat(frames, ignore_index=True).astype({"x": float, "y": float})
    df = spark.createDataFrame(pdf)
    for parts in (1, 7):
        got = hull.convex_hull(df.repartition(parts), "g").toPandas()
        for g, part in pdf.groupby("g"):
            ring = got[got["g"] == g].sort_values("seq")[["x", "y"]].to_numpy()
            pts = part[["x", "y"]].to_numpy()
            if g in ("hot", "circle"):
                assert set(map(tuple, ring)) == brute_hull(pts)
                nxt = np.roll(ring, -1, axis=0)
                for p in pts:
                    cross = (nxt - ring)[:, 0] * (p[1] - ring[:, 1]) - (nxt - ring)[:, 1] * (p[0] - ring[:, 0])
                    assert (cross >= -1e-9).all()
            assert np.array_equal(hull.hull_ring(ring), ring) or g in ("line", "dot")
        assert len(got[got["g"] == "line"]) == 2 and len(got[got["g"] == "dot"]) == 1


def inside_at(ring, y):
    """The x intervals of a polygon at a height that meets no vertex."""
    xs = sorted(x1 + (x2 - x1) * (y - y1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]) if (y1 > y) != (y2 > y))
    return list(zip(xs[::2], xs[1::2]))


def width_outside(ring, masks, y):
    total = 0.0
    for a, b in inside_at(ring, y):
        cuts = sorted((max(a, c), min(b, d)) for m in masks for c, d in inside_at(m, y) if d > a and c < b)
        at, hidden = a, 0.0
        for c, d in cuts:
            hidden += max(0.0, d - max(c, at))
            at = max(at, d)
        total += b - a - hidden
    return total


SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
SHAPES = {
    "nothing": [],
    "a corner": [[(8.0, 8.0), (13.0, 8.0), (13.0, 13.0), (8.0, 13.0)]],
    "all": [[(-1.0, -1.0), (11.0, -1.0), (11.0, 11.0), (-1.0, 11.0)]],
    "two that overlap": [[(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)], [(4.0, 3.0), (9.0, 5.0), (5.0, 9.0)]],
    "a bent one": [[(1.0, 1.0), (9.0, 2.0), (8.5, 4.0), (4.0, 3.0), (3.0, 8.0), (0.5, 9.0)]],
    "outside": [[(20.0, 0.0), (21.0, 0.0), (21.0, 5.0)]],
}


def test_area_outside_masks_of_any_shape(spark):
    def edges(rows):
        flat = [(k, p, *map(float, (*r[i], *r[(i + 1) % len(r)]))) for k, p, r in rows for i in range(len(r))]
        return spark.createDataFrame(flat, "k string, poly_id string, x1 double, y1 double, x2 double, y2 double")

    tilted = [(1.0, -2.0), (9.0, 0.5), (11.0, 7.0), (4.0, 11.0), (-1.5, 5.0)]
    rings = {f"{name}/{i}": (ring, masks) for name, masks in SHAPES.items() for i, ring in enumerate((SQUARE, tilted))}
    kept = edges([(k, "hull", ring) for k, (ring, _) in rings.items()])
    masks = edges([(k, f"m{i}", m) for k, (_, ms) in rings.items() for i, m in enumerate(ms)])
    for strip in (1.7, 100.0):
        got = {r["k"]: r["area"] for r in polygons.area_outside(kept, masks, "k", strip).collect()}
        for name, (ring, ms) in rings.items():
            step = 0.001
            want = sum(width_outside(ring, ms, y) for y in np.arange(-3, 13, step) + 0.000311) * step
            assert got[name] == pytest.approx(want, abs=0.02), name
    assert got["nothing/0"] == pytest.approx(100.0, abs=1e-12) and got["a corner/0"] == pytest.approx(96.0, abs=1e-12)
    assert got["all/1"] == pytest.approx(0.0, abs=12.0)


def test_points_in_line_up_to_rounding_are_not_vertices(spark):
    """A projected meridian is a straight line whose points deviate from it by rounding only."""
    lats = np.linspace(48.0, 52.0, 401)
    pdf = pd.DataFrame([(lon, lat) for lon in (-123.0, -124.37, -129.99) for lat in lats], columns=["lon", "lat"])
    pts = grid.project(spark.createDataFrame(pdf), Albers()).withColumn("g", F.lit("all"))
    for parts in (1, 5):
        ring = hull.convex_hull(pts.repartition(parts), "g").toPandas()
        corners = pts.where(F.col("lon").isin(-123.0, -129.99) & F.col("lat").isin(48.0, 52.0)).toPandas()
        middle = pts.where((F.col("lon") == -124.37) & (F.col("lat") == 48.0)).toPandas()
        expect = {(round(x, 3), round(y, 3)) for x, y in pd.concat([corners, middle])[["x", "y"]].to_numpy()}
        assert {(round(x, 3), round(y, 3)) for x, y in ring[["x", "y"]].to_numpy()} == expect
