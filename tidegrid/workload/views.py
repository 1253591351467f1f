"""Stand-in inputs over the test tables, as DataFrames (``oracle_views`` has the SQL side)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegrid.functions.coords import Albers, GridSpec
from tidegrid.functions.recode import case_of, presence, regime_of
from tidegrid.operators import dedup, encode, grid, rollup
from tidegrid.sources.tables import read_table

CRS = Albers()
GRID = GridSpec()
CELL_SIZES = [2000.0, 10000.0]
REGIMES = [("pre", None, 1997), ("crash", 1998, 1998), ("post", 1999, None)]
TIEBREAK = ["l_orderkey", "l_linenumber", "l_partkey", "source", "lat", "lon", "bottom_time", "area"]
SOURCES = ["AF", "AO", "NF", "NO", "RF", "RO"]
FIRST_YEAR, LAST_YEAR = 1995, 2001

# Polygons given as arguments, in (lon, lat); vertices lie off the data lattice.
WATER = {
    "water": [
        (-129.305, 48.505), (-129.305, 51.705), (-126.105, 51.705),
        (-126.105, 50.305), (-124.205, 50.305), (-124.205, 48.505),
    ]
}


def surveys(spark: SparkSession, sf: str) -> DataFrame:
    pk, qty = F.col("l_partkey"), F.col("l_quantity")
    timed = pk % 7 != 0
    return read_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.concat("l_returnflag", "l_linestatus").alias("source"),
        F.to_date("l_shipdate").alias("obs_date"),
        F.year("l_shipdate").alias("year"),
        F.when(pk % 97 != 0, (pk % 400) / 100.0 + 48.0).alias("lat"),
        F.when(pk % 97 != 0, -((pk % 700) / 100.0 + 123.0)).alias("lon"),
        F.when(pk % 89 == 0, None)
        .when((pk % 5 < 3) & (F.col("l_orderkey") % 13 != 0), 0.0)
        .otherwise((qty.cast("long") % 13).cast("double")).alias("num_target"),
        F.when((F.col("l_linestatus") == "F") & timed, qty).alias("bottom_time"),
        F.when((F.col("l_linestatus") == "O") & timed, F.col("l_tax") * 100 + qty).alias("area"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    short = F.concat_ws(
        "/", F.month("ts"), F.dayofmonth("ts"), F.lpad((F.year("ts") % 100).cast("string"), 2, "0")
    )
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("formid"),
        ((user % 4 + 1) * 10000 + user).cast("string").alias("geogr"),
        F.when(F.col("event_id") % 2 == 0, short)
        .otherwise(F.to_date("ts").cast("string")).alias("date_text"),
        F.when(user % 3 == 0, "N").otherwise("E").alias("exp"),
        F.col("value").alias("btime"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    user, eid = F.col("user_id"), F.col("event_id")
    return read_table(spark, sf, "events").where(F.col("event_type") == "purchase").select(
        F.when(user % 20 == 0, eid + 10000000).otherwise(eid).alias("form"),
        ((user % 4 + 1) * 10000 + user).cast("string").alias("geozone"),
        (eid % 4 + 1).cast("int").alias("abundance"),
    )


def species_rows(spark: SparkSession, sf: str) -> DataFrame:
    eid, value = F.col("event_id"), F.col("value")
    words = ["none", "few", "present", "some", "many", "very many", "abundant", "very abundant", "5+", "?", None]
    tags = case_of([(eid % 14 == i, F.lit(w)) for i, w in enumerate(words)])
    return read_table(spark, sf, "events").select(
        eid.alias("row_id"),
        F.to_date("ts").alias("date_observed"),
        (F.col("user_id") % 20).alias("place"),
        F.col("user_id").alias("observer"),
        F.col("event_type").alias("species"),
        F.when(eid % 14 < len(words), tags)
        .otherwise(F.floor(value).cast("long").cast("string")).alias("tags"),
        F.when(eid % 23 != 0, value).alias("max_depth"),
    )


def site_text(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    text = lambda sign, base, step, by: F.when(key % 17 == 0, "NULL").otherwise(
        F.concat(
            F.lit(sign), (key % by + base).cast("string"), F.lit(" "),
            (key * step % 60).cast("string"), F.lit("."), (key % 10).cast("string"),
        )
    )
    return read_table(spark, sf, "supplier").select(
        key.cast("string").alias("geogid"),
        text("", 48, 7, 4).alias("lat"),
        text("-", 123, 11, 5).alias("lon"),
    )


def catches(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kinds = ["crab", "prawn", "trawl", "longline"]
    return read_table(spark, sf, "orders").select(
        key.alias("haul"),
        case_of([(cust % 4 == i, F.lit(k)) for i, k in enumerate(kinds)]).alias("fishery"),
        F.when(F.col("o_orderpriority").startswith("1"), "TGT").otherwise("OTH").alias("species_code"),
        F.year("o_orderdate").alias("year"),
        (cust % 4 + 48).cast("double").alias("lat_deg"),
        (key * 7 % 600 / 10.0).alias("lat_min"),
        (cust % 5 + 123).cast("double").alias("lon_deg"),
        (key * 11 % 600 / 10.0).alias("lon_min"),
        (F.col("o_totalprice") / 10000.0).alias("max_depth"),
        F.when(F.col("o_orderstatus") == "F", "F").otherwise("M").alias("depth_unit"),
        (key % 4).cast("int").alias("catch_count"),
    )


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    angle = key % 40 * (2 * F.pi()) / 40.0
    radius = F.col("p_retailprice") + 1000.0
    return read_table(spark, sf, "part").select(
        F.floor(key / 40).cast("long").alias("poly_id"),
        (key % 40).cast("int").alias("seq"),
        (radius * F.cos(angle)).alias("x"),
        (radius * F.sin(angle)).alias("y"),
    )


def draws(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("vec_id")
    return read_table(spark, sf, "embeddings").select(
        vec.alias("draw"),
        (vec % 4).cast("int").alias("chain"),
        F.floor(vec / 4).cast("long").alias("iteration"),
        F.transform("embedding", lambda v: v.cast("double")).alias("e"),
    )


def value(e: Column, number: Column | int) -> Column:
    """Stand-in value of a numbered parameter in a draw: a mix of two of the draw's 64 numbers with weights that no
    other number has.  Any number of parameters get values of their own."""
    k = (number if isinstance(number, Column) else F.lit(number)).cast("bigint")
    at = lambda i: F.get(e, (i % 64).cast("int"))
    return at(k) * F.cos(k.cast("double")) + at(k * 7 + 3) * F.sin(k.cast("double"))


def values(numbers: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``value`` of many parameters in many draws: parameters x draws, from draws x 64 numbers."""
    of, k = numbers.T, wanted.astype(np.int64)
    return of[k % 64] * np.cos(k.astype(float))[:, None] + of[(k * 7 + 3) % 64] * np.sin(k.astype(float))[:, None]


def positive(e: Column, number: int, least: float) -> Column:
    return F.abs(value(e, number)) + least


# numbers of the first of the presence model's deviations; a site's is its own id
OBS_DEV, A_SOURCE, A_SITE = 500_000, 510_000, 9_000_000


def _cutpoints(e: Column, n: int) -> Column:
    """Increasing cutpoints from values 23 onwards."""
    cuts = [e[22]]
    for k in range(1, n):
        cuts.append(cuts[-1] + (F.abs(e[22 + k]) + 0.1))
    return F.array(*cuts)


def sites(spark: SparkSession, sf: str) -> Column:
    """The number of sites, which have the ids 1 to that."""
    return read_table(spark, sf, "supplier").agg(F.count(F.lit(1)).cast("int")).scalar()


def params(spark: SparkSession, sf: str, held: DataFrame | None = None) -> DataFrame:
    """One row per draw: scalars, and vector parameters as arrays.  Of all draws, or of those ``held`` with further columns."""
    e = F.col("e")
    at = lambda i: e[i - 1]
    above = lambda i, add: F.abs(at(i)) + add
    numbered = lambda first, n: F.transform(F.sequence(F.lit(1), n), lambda i: value(e, i + first))
    rows = draws(spark, sf) if held is None else held
    own = [c for c in rows.columns if c != "e"]
    return rows.withColumn("sites", sites(spark, sf)).select(
        *own,
        F.slice(e, 1, 22).alias("dev"),
        numbered(OBS_DEV, F.lit(22)).alias("obs_dev"),
        _cutpoints(e, 4).alias("cuts5"),
        _cutpoints(e, 6).alias("cuts7"),
        at(29).alias("x0"), at(30).alias("u_pre"), at(31).alias("u_crash"), at(32).alias("u_post"),
        above(33, 0.05).alias("sd_q"), above(34, 0.05).alias("sd_r"),
        at(35).alias("a_b"), at(36).alias("a_c"),
        above(37, 0.5).alias("phi"), at(38).alias("theta"),
        at(39).alias("beta_time"), at(40).alias("beta_area"), at(41).alias("a_area"),
        above(42, 0.05).alias("sd_site"), above(43, 0.05).alias("sd_source"),
        numbered(A_SOURCE, F.lit(len(SOURCES))).alias("a_source"),
        numbered(A_SITE, F.col("sites")).alias("a_site"),
    )


def deduped(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keep_max(surveys(spark, sf), ["site", "obs_date"], "num_target", TIEBREAK)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return grid.project(surveys(spark, sf), CRS)


def regime_points(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).withColumn("regime", regime_of("year", REGIMES))


def site_years(spark: SparkSession, sf: str) -> DataFrame:
    flagged = surveys(spark, sf).withColumn("presence", presence("num_target"))
    return rollup.site_year_rollup(
        flagged, ["source", "year", "lat", "lon"], "num_target", "presence"
    )


def site_year_cells(spark: SparkSession, sf: str) -> DataFrame:
    pts = grid.project(site_years(spark, sf), CRS).withColumn("regime", regime_of("year", REGIMES))
    return grid.assign_cells(pts, GRID, CELL_SIZES)


def presence_design(spark: SparkSession, sf: str) -> DataFrame:
    from tidegrid.operators.ranks import with_dense_id

    df = surveys(spark, sf).withColumns(
        {
            "time": F.col("bottom_time"),
            "presence": presence("num_target"),
            "year_id": F.col("year") - (FIRST_YEAR - 1),
            "site_id": F.col("site") + 1,
        }
    )
    return with_dense_id(encode.effort_design(df), "source", "source_id")
