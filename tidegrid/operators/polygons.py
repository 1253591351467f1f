"""Polygons as edge tables: edges, areas, point in polygon, exact areas of what masks leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def ring_edges(vertices: DataFrame, keys: list[str], seq: str, x: str, y: str) -> DataFrame:
    """Edges of closed rings from vertex rows numbered 0..n-1.

    The next vertex is found by an equi-join on its number, which spreads a long ring over
    tasks; a ``lead`` window would put a whole ring in one.
    """
    sizes = vertices.groupBy(*keys).agg((F.max(seq) + 1).alias("__n"))
    start = vertices.select(*keys, seq, F.col(x).alias("x1"), F.col(y).alias("y1")).join(sizes, keys)
    start = start.withColumn("__next", (F.col(seq) + 1) % F.col("__n"))
    end = vertices.select(
        *keys, F.col(seq).alias("__next"), F.col(x).alias("x2"), F.col(y).alias("y2")
    )
    return start.join(end, [*keys, "__next"]).select(*keys, seq, "x1", "y1", "x2", "y2")


def literal_edges(spark: SparkSession, polygons: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Edge table of polygons given as arguments (the planner knows its exact size)."""
    rows = [
        (name, *ring[i], *ring[(i + 1) % len(ring)])
        for name, ring in polygons.items()
        for i in range(len(ring))
    ]
    rows = [tuple([r[0], *map(float, r[1:])]) for r in rows]
    return spark.createDataFrame(rows, "poly_id string, x1 double, y1 double, x2 double, y2 double")


def ring_area(edges: DataFrame, keys: list[str], unit: float = 1.0) -> DataFrame:
    """Shoelace area per ring; with an equal-area projection this is the true area."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edges.groupBy(*keys).agg(
        (F.abs(F.sum(cross)) / 2.0 / unit).alias("area"), F.count(F.lit(1)).alias("n_edges")
    )


def crosses(px: Column, py: Column, edge=F.col) -> Column:
    """A ray from the point towards +x crosses the edge (half-open in y, so a vertex counts once)."""
    x1, y1, x2, y2 = (edge(c) for c in ("x1", "y1", "x2", "y2"))
    at = x1 + F.try_divide((x2 - x1) * (py - y1), y2 - y1)
    return ((y1 > py) != (y2 > py)) & (px < at)


def _strip_of(c: Column | str, strip: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / strip).cast("long")


def _by_strip(edges: DataFrame, strip: float) -> DataFrame:
    """Edges listed under each horizontal strip they touch."""
    first = _strip_of(F.least("y1", "y2"), strip)
    last = _strip_of(F.greatest("y1", "y2"), strip)
    return edges.withColumn("__strip", F.explode(F.sequence(first, last)))


def points_in_polygons(
    points: DataFrame, edges: DataFrame, strip: float, x: str = "x", y: str = "y"
) -> DataFrame:
    """(x, y, poly_id) for every distinct point inside a polygon, by crossing parity.

    Repeated coordinates are tested once.  Edges are listed under each horizontal strip they
    touch and points look up their own strip, an equi-join; the crossing test is part of the
    join condition, so only real crossings leave the join.  The parity sum combines on the map
    side, and a strip that holds many points is split by adaptive execution, because its edges
    can be repeated to every split.
    """
    spots = points.select(F.col(x).alias("__x"), F.col(y).alias("__y")).distinct()
    spots = spots.withColumn("__at", _strip_of("__y", strip))
    hits = spots.join(
        _by_strip(edges, strip),
        (F.col("__at") == F.col("__strip")) & crosses(F.col("__x"), F.col("__y")),
    )
    return (
        hits.groupBy("__x", "__y", "poly_id")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") % 2 == 1)
        .select(F.col("__x").alias(x), F.col("__y").alias(y), "poly_id")
    )


def keep_inside(
    df: DataFrame, edges: DataFrame, strip: float, x: str = "x", y: str = "y"
) -> DataFrame:
    """Rows whose point lies in a polygon, with the polygon's id (inner join)."""
    return df.join(points_in_polygons(df, edges, strip, x, y), [x, y])


def keep_outside(
    df: DataFrame, edges: DataFrame, strip: float, x: str = "x", y: str = "y", keys: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Rows whose point lies in no polygon.

    With ``keys``, pairs of a row's and an edge's column, only polygons of the same key count: a mask
    for each period.
    """
    if not keys:
        return df.join(points_in_polygons(df, edges, strip, x, y), [x, y], "left_anti")
    mine, theirs = zip(*keys)
    spots = df.select(*mine, F.col(x).alias("__x"), F.col(y).alias("__y")).distinct()
    spots = spots.withColumn("__at", _strip_of("__y", strip))
    listed = _by_strip(edges, strip).withColumns({f"__k{i}": F.col(t) for i, t in enumerate(theirs)})
    listed = listed.select("poly_id", "x1", "y1", "x2", "y2", "__strip", *[f"__k{i}" for i in range(len(theirs))])
    same = (F.col("__at") == F.col("__strip")) & crosses(F.col("__x"), F.col("__y"))
    for i, m in enumerate(mine):
        same = same & (F.col(m) == F.col(f"__k{i}"))
    hits = (
        spots.join(listed, same)
        .groupBy(*mine, "__x", "__y", "poly_id")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") % 2 == 1)
        .select(*mine, F.col("__x").alias(x), F.col("__y").alias(y))
        .distinct()
    )
    return df.join(hits, [*mine, x, y], "left_anti")


def area_outside(kept: DataFrame, masks: DataFrame, key: str, strip: float) -> DataFrame:
    """(key, area) of what the masks of a key leave of its polygon, exact but for rounding.

    Both tables have ``key``, poly_id and x1, y1, x2, y2; masks may overlap, be of any shape and be absent.  A plane sweep:
    between two neighbouring heights at which an edge begins, ends or crosses another, edges keep their order, so what
    lies between two of them is a trapezoid, inside the polygon and outside all masks or not.  ``strip`` cuts
    the plane for finding the crossings: only edges of one horizontal strip meet.
    """
    both = kept.withColumn("__mask", F.lit(False)).unionByName(masks.withColumn("__mask", F.lit(True)), allowMissingColumns=True)
    up = F.col("y1") < F.col("y2")
    ends = {"ax": F.when(up, F.col("x1")).otherwise(F.col("x2")), "ay": F.least("y1", "y2"), "bx": F.when(up, F.col("x2")).otherwise(F.col("x1")), "by": F.greatest("y1", "y2")}
    edges = both.where("y1 <> y2").withColumns(ends).select(key, "poly_id", "__mask", *ends)
    edges = edges.withColumn("slope", (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))

    listed = edges.withColumn("__strip", F.explode(F.sequence(_strip_of("ay", strip), _strip_of("by", strip))))
    other = listed.toDF(*[f"o_{c}" for c in listed.columns])
    pairs = listed.join(other, (F.col(key) == F.col(f"o_{key}")) & (F.col("__strip") == F.col("o___strip")) & (F.col("poly_id") < F.col("o_poly_id")))
    at = F.try_divide(
        F.col("o_ax") - F.col("o_slope") * F.col("o_ay") - F.col("ax") + F.col("slope") * F.col("ay"), F.col("slope") - F.col("o_slope")
    )
    crossing = pairs.select(key, at.alias("y"), F.greatest("ay", "o_ay").alias("__lo"), F.least("by", "o_by").alias("__hi"))
    crossing = crossing.where("y > __lo AND y < __hi").select(key, "y")
    heights = edges.select(key, F.explode(F.array("ay", "by")).alias("y")).unionByName(crossing).distinct()
    order = Window.partitionBy(key).orderBy("y")
    levels = heights.withColumns({"top": F.lead("y").over(order)}).where("top IS NOT NULL").withColumnsRenamed({key: "__key", "y": "low"})

    over = edges.join(levels, (F.col(key) == F.col("__key")) & (F.col("ay") <= F.col("low")) & (F.col("by") >= F.col("top")))
    x = lambda y: F.col("ax") + F.col("slope") * (F.col(y) - F.col("ay"))
    edge = F.struct((x("low") + x("top")).alias("place"), x("low").alias("x_low"), x("top").alias("x_top"), "poly_id", "__mask")
    sweeps = over.groupBy(key, "low", "top").agg(F.array_sort(F.collect_list(edge)).alias("edges"))

    def toggled(open_: Column, poly: Column, mine: Column) -> Column:
        flipped = F.when(F.array_contains(open_, poly), F.array_remove(open_, poly)).otherwise(F.array_append(open_, poly))
        return F.when(mine, flipped).otherwise(open_)

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("inside"), none.alias("hidden"), F.lit(0.0).alias("x_low"), F.lit(0.0).alias("x_top"), F.lit(0.0).alias("width"))

    def step(acc: Column, e: Column) -> Column:
        counts = (F.size(acc["inside"]) > 0) & (F.size(acc["hidden"]) == 0)
        width = F.when(counts, (e["x_low"] - acc["x_low"] + e["x_top"] - acc["x_top"]) / 2.0).otherwise(0.0)
        return F.struct(
            toggled(acc["inside"], e["poly_id"], ~e["__mask"]).alias("inside"), toggled(acc["hidden"], e["poly_id"], e["__mask"]).alias("hidden"),
            e["x_low"].alias("x_low"), e["x_top"].alias("x_top"), (acc["width"] + width).alias("width"),
        )

    width = F.aggregate("edges", start, step, lambda acc: acc["width"])
    return sweeps.groupBy(key).agg(F.sum(width * (F.col("top") - F.col("low"))).alias("area"))
