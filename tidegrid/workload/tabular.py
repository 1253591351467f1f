"""Sources, projections, filters, keys, joins, aggregations, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidegrid.functions import coords, missing, recode
from tidegrid.functions.dates import mixed_date_parts
from tidegrid.operators import combine, dedup, encode, lookup, ranks, rollup
from tidegrid.plans import surveys
from tidegrid.sources import tables
from tidegrid.workload import views
from tidegrid.workload.registry import query, round_all, rounded

# --- sources, sinks, schema ---------------------------------------------------------------

LINEITEM = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]
)


@query(
    "scan_survey",
    """
    SELECT l_suppkey AS site, l_returnflag AS source, count(*) AS n,
           CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_date,
           CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last_date, sum(l_quantity) AS effort
    FROM lineitem GROUP BY ALL
    """,
)
def scan_survey(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.schema(LINEITEM).parquet(f"{sf}/lineitem.parquet")
    day = F.to_date("l_shipdate")
    return df.groupBy(F.col("l_suppkey").alias("site"), F.col("l_returnflag").alias("source")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(day).cast("string").alias("first_date"),
        F.max(day).cast("string").alias("last_date"),
        F.sum("l_quantity").alias("effort"),
    )


@query(
    "scan_typed_coerce",
    """
    SELECT tags, count(*) AS n, count(TRY_CAST(tags AS DOUBLE)) AS n_numeric,
           min(TRY_CAST(tags AS DOUBLE)) AS number
    FROM species_rows GROUP BY tags
    """,
    ("species_rows",),
)
def scan_typed_coerce(spark, sf):
    num = missing.as_number("tags")
    return views.species_rows(spark, sf).groupBy("tags").agg(
        F.count(F.lit(1)).alias("n"), F.count(num).alias("n_numeric"), F.min(num).alias("number")
    )


@query(
    "normalise_names",
    """
    SELECT c_custkey AS site_id, c_name AS max_depth, c_nationkey AS date, c_acctbal AS date_2,
           c_mktsegment AS count_of7ab FROM customer
    """,
)
def normalise_names(spark, sf):
    raw = tables.read_table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    return tables.normalise_names(raw.toDF("SiteID", "Max. depth", "date", "Date ", "CountOf7AB"))


@query(
    "sink_roundtrip",
    """
    SELECT source, year, count(*) AS n, count(lat) AS n_located, sum(num_target) AS total,
           CAST(max(obs_date) AS VARCHAR) AS last_date
    FROM surveys GROUP BY source, year
    """,
    ("surveys",),
)
def sink_roundtrip(spark, sf):
    """Write the survey table as CSV partitioned by source, read it back with a schema."""
    df = views.surveys(spark, sf)
    path = tables.shared_folder(spark)
    tables.write_csv(df, path, ["source"])
    fields = [f for f in df.schema.fields if f.name != "source"] + [df.schema["source"]]
    back = tables.read_csv(spark, path, T.StructType(fields))
    return back.groupBy("source", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count("lat").alias("n_located"),
        F.sum("num_target").alias("total"), F.max("obs_date").cast("string").alias("last_date"),
    )


# --- projections and filters --------------------------------------------------------------


@query(
    "harmonise_columns",
    """
    SELECT year, CAST(month(obs_date) AS INTEGER) AS month, CAST(day(obs_date) AS INTEGER) AS day,
           CAST(site AS VARCHAR) AS site, source, num_target AS num_count,
           CASE WHEN num_target > 0 THEN 1 ELSE 0 END AS presence,
           bottom_time AS time, area, lat AS dec_lat, lon AS dec_long
    FROM surveys
    """,
    ("surveys",),
)
def harmonise_columns(spark, sf):
    df = views.surveys(spark, sf).withColumnsRenamed(
        {"num_target": "num_count", "bottom_time": "time", "lat": "dec_lat", "lon": "dec_long"}
    )
    return df.select(
        "year", F.month("obs_date").alias("month"), F.day("obs_date").alias("day"),
        F.col("site").cast("string").alias("site"), "source", "num_count",
        recode.presence("num_count").alias("presence"), "time", "area", "dec_lat", "dec_long",
    )


@query(
    "drop_column_range",
    "SELECT site, source, year, l_orderkey, l_linenumber, l_partkey FROM surveys",
    ("surveys",),
)
def drop_column_range(spark, sf):
    df = combine.drop_range(views.surveys(spark, sf), "lat", "area")
    kept = combine.keep_range(df, "site", "l_partkey")
    return kept.drop("obs_date")


@query(
    "tag_source",
    """
    SELECT dataset, year, count(*) AS n FROM (
      SELECT 'surveys' AS dataset, year FROM surveys
      UNION ALL SELECT 'catches' AS dataset, year FROM catches) GROUP BY ALL
    """,
    ("surveys", "catches"),
)
def tag_source(spark, sf):
    a = views.surveys(spark, sf).withColumn("dataset", F.lit("surveys"))
    b = views.catches(spark, sf).withColumn("dataset", F.lit("catches"))
    return rollup.count_by(combine.union_sources(a, b), "dataset", "year")


SCORE_SQL = """
CASE WHEN tags = 'none' THEN 0 WHEN tags = 'few' THEN 1 WHEN tags = 'present' THEN 1
     WHEN tags = 'some' THEN 2 WHEN tags = 'many' THEN 3 WHEN tags = 'very many' THEN 4
     WHEN tags = 'abundant' THEN 5 WHEN tags = 'very abundant' THEN 6 WHEN tags = '5+' THEN 1
     WHEN TRY_CAST(tags AS DOUBLE) < 11 THEN 1
     WHEN TRY_CAST(tags AS DOUBLE) > 10 AND TRY_CAST(tags AS DOUBLE) < 26 THEN 2
     WHEN TRY_CAST(tags AS DOUBLE) > 25 AND TRY_CAST(tags AS DOUBLE) < 51 THEN 3
     WHEN TRY_CAST(tags AS DOUBLE) > 50 AND TRY_CAST(tags AS DOUBLE) < 101 THEN 4
     WHEN TRY_CAST(tags AS DOUBLE) > 100 AND TRY_CAST(tags AS DOUBLE) < 1001 THEN 5
     WHEN TRY_CAST(tags AS DOUBLE) > 1000 THEN 6 END
"""


@query(
    "ordinal_recode",
    f"""
    SELECT row_id, species, score, seen,
           CASE WHEN seen = 0 THEN 1 ELSE score + 1 END AS score_recode
    FROM (SELECT *, {SCORE_SQL} AS score, CASE WHEN species = 'purchase' THEN 1 ELSE 0 END AS seen
          FROM species_rows)
    """,
    ("species_rows",),
)
def ordinal_recode(spark, sf):
    df = views.species_rows(spark, sf).withColumns(
        {
            "score": recode.tag_to_score("tags"),
            "seen": F.when(F.col("species") == "purchase", 1).otherwise(0),
        }
    )
    return df.select(
        "row_id", "species", "score", "seen",
        recode.shift_score("seen", "score").alias("score_recode"),
    )


@query(
    "score_to_count",
    f"""
    SELECT score, five, seven, count(*) AS n FROM (
      SELECT score,
             CASE score WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 11 WHEN 4 THEN 101 END AS five,
             CASE score + 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 11 WHEN 4 THEN 26 WHEN 5 THEN 51
                            WHEN 6 THEN 101 WHEN 7 THEN 1001 END AS seven
      FROM (SELECT {SCORE_SQL} AS score FROM species_rows)) GROUP BY ALL
    """,
    ("species_rows",),
)
def score_to_count(spark, sf):
    df = views.species_rows(spark, sf).select(recode.tag_to_score("tags").alias("score"))
    df = df.withColumns(
        {
            "five": recode.score_to_count("score", recode.FIVE_LEVEL_COUNTS),
            "seven": recode.score_to_count(F.col("score") + 1, recode.SEVEN_LEVEL_COUNTS, first=1),
        }
    )
    return rollup.count_by(df, "score", "five", "seven")


@query(
    "presence_flag",
    """
    SELECT source, CASE WHEN num_target > 0 THEN 1 ELSE 0 END AS by_count,
           CASE WHEN num_target = 0 THEN 0 ELSE 1 END AS by_score,
           CASE right(source, 1) WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS status_binary, count(*) AS n
    FROM surveys GROUP BY ALL
    """,
    ("surveys",),
)
def presence_flag(spark, sf):
    df = views.surveys(spark, sf).select(
        "source",
        recode.presence("num_target").alias("by_count"),
        recode.present_unless_zero("num_target").alias("by_score"),
        recode.binary_of(F.right("source", F.lit(1)), "F", "O").alias("status_binary"),
    )
    return rollup.count_by(df, *df.columns)


@query(
    "regime_flags",
    """
    SELECT year, CASE WHEN year < 1998 THEN 0 ELSE 1 END AS after_start,
           CASE WHEN year IN (1998, 1999) THEN 1 ELSE 0 END AS during,
           CASE WHEN year < 1997 THEN 'pre' WHEN year >= 1999 THEN 'post' END AS spatial_regime,
           count(*) AS n
    FROM surveys GROUP BY ALL
    """,
    ("surveys",),
)
def regime_flags(spark, sf):
    df = views.surveys(spark, sf).select(
        "year",
        recode.regime_of("year", [(0, None, 1997), (1, 1998, None)]).alias("after_start"),
        recode.regime_of("year", [(1, 1998, 1999), (0, None, None)]).alias("during"),
        recode.regime_of("year", [("pre", None, 1996), ("post", 1999, None)]).alias("spatial_regime"),
    )
    return rollup.count_by(df, *df.columns)


@query(
    "fallback_key",
    """
    SELECT when_text, place, count(*) AS n FROM (
      SELECT coalesce(CASE WHEN num_target > 0 THEN CAST(obs_date AS VARCHAR) END, CAST(year AS VARCHAR)) AS when_text,
             coalesce(CASE WHEN area IS NOT NULL THEN CAST(site AS VARCHAR) END,
                      concat(coalesce(CAST(lat AS VARCHAR), 'NA'), '_', coalesce(CAST(lon AS VARCHAR), 'NA'))) AS place
      FROM surveys) GROUP BY ALL
    """,
    ("surveys",),
)
def fallback_key(spark, sf):
    day = F.when(F.col("num_target") > 0, F.col("obs_date").cast("string"))
    site = F.when(F.col("area").isNotNull(), F.col("site").cast("string"))
    df = views.surveys(spark, sf).select(
        F.coalesce(day, F.col("year").cast("string")).alias("when_text"),
        F.coalesce(site, missing.paste("lat", "lon")).alias("place"),
    )
    return rollup.count_by(df, "when_text", "place")


@query(
    "dm_to_degrees",
    """
    SELECT haul, round(lat_deg + lat_min / 60, 9) AS lat, round(-(lon_deg + lon_min / 60), 9) AS lon,
           round(CASE WHEN depth_unit = 'F' THEN max_depth / 3.28084e0 ELSE max_depth END, 9) AS depth_m
    FROM catches
    """,
    ("catches",),
)
def dm_to_degrees(spark, sf):
    return views.catches(spark, sf).select(
        "haul",
        rounded(coords.degrees_minutes("lat_deg", "lat_min"), 9).alias("lat"),
        rounded(-coords.degrees_minutes("lon_deg", "lon_min"), 9).alias("lon"),
        rounded(recode.metres("max_depth", "depth_unit"), 9).alias("depth_m"),
    )


@query(
    "filter_predicates",
    """
    SELECT source, year, count(*) AS n, sum(num_target) AS total FROM surveys
    WHERE num_target IS NOT NULL AND lat IS NOT NULL AND num_target <> 3 AND year > 1995
      AND NOT (source = 'AF' AND num_target = 4) GROUP BY ALL
    """,
    ("surveys",),
)
def filter_predicates(spark, sf):
    df = views.surveys(spark, sf).dropna(subset=["num_target", "lat"])
    df = df.where((F.col("num_target") != 3) & (F.col("year") > 1995))
    df = df.where(~((F.col("source") == "AF") & (F.col("num_target") == 4)))
    return df.groupBy("source", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_target").alias("total")
    )


@query(
    "regex_filters",
    """
    SELECT geogr, slash, tag_clean, count(*) AS n FROM (
      SELECT geogr, CAST(contains(date_text, '/') AS INTEGER) AS slash,
             CAST(NOT coalesce(regexp_matches(CASE WHEN exp = 'N' THEN geogr END, '^1.*[02468]$'), false) AS INTEGER) AS tag_clean
      FROM text_dates WHERE regexp_matches(geogr, '^1')) GROUP BY ALL
    """,
    ("text_dates",),
)
def regex_filters(spark, sf):
    df = views.text_dates(spark, sf).where(missing.matches("geogr", "^1"))
    tag = F.when(F.col("exp") == "N", F.col("geogr"))
    df = df.select(
        "geogr",
        missing.matches("date_text", "/").cast("int").alias("slash"),
        (~missing.matches(tag, "^1.*[02468]$")).cast("int").alias("tag_clean"),
    )
    return rollup.count_by(df, "geogr", "slash", "tag_clean")


@query(
    "regime_split",
    """
    SELECT CASE WHEN year <= 1997 THEN 'pre' WHEN year = 1998 THEN 'crash' ELSE 'post' END AS regime,
           count(*) AS n, count(DISTINCT site) AS n_sites, sum(num_target) AS total
    FROM surveys WHERE year BETWEEN 1996 AND 2001 GROUP BY ALL
    """,
    ("surveys",),
)
def regime_split(spark, sf):
    df = views.surveys(spark, sf).where(F.col("year").between(1996, 2001))
    return df.groupBy(recode.regime_of("year", views.REGIMES).alias("regime")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("site").alias("n_sites"),
        F.sum("num_target").alias("total"),
    )


@query(
    "exclude_records",
    """
    SELECT source, year, count(*) AS n, sum(num_target) AS total FROM surveys s
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = s.l_orderkey
                      AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'P')
    GROUP BY ALL
    """,
    ("surveys",),
)
def exclude_records(spark, sf):
    listed = tables.read_table(spark, sf, "orders").where(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    )
    listed = listed.select(F.col("o_orderkey").alias("l_orderkey"))
    kept = lookup.exclude(views.surveys(spark, sf), listed, ["l_orderkey"])
    return kept.groupBy("source", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_target").alias("total")
    )


@query(
    "sentinel_nulls",
    """
    SELECT geogid, CASE WHEN lat <> 'NULL' THEN lat END AS lat_text,
           CASE WHEN s_acctbal > 0 THEN round(s_acctbal, 6) END AS mean_count
    FROM site_text JOIN supplier ON geogid = CAST(s_suppkey AS VARCHAR)
    """,
    ("site_text",),
)
def sentinel_nulls(spark, sf):
    means = tables.read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("geogid"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(F.lit(float("nan"))).alias("m"),
    )
    return views.site_text(spark, sf).join(means, "geogid").select(
        "geogid",
        missing.sentinel_to_null("lat", "NULL").alias("lat_text"),
        rounded(missing.nan_to_null("m")).alias("mean_count"),
    )


# --- keys, strings, dates -----------------------------------------------------------------


@query(
    "composite_keys",
    """
    SELECT site_ymd, count(*) AS n FROM (
      SELECT concat(coalesce(CAST(lat AS VARCHAR), 'NA'), '_', coalesce(CAST(lon AS VARCHAR), 'NA'), '_',
                    CAST(year AS VARCHAR), '_', CAST(month(obs_date) AS VARCHAR)) AS site_ymd
      FROM surveys) GROUP BY site_ymd
    """,
    ("surveys",),
)
def composite_keys(spark, sf):
    key = missing.paste("lat", "lon", "year", F.month("obs_date")).alias("site_ymd")
    return rollup.count_by(views.surveys(spark, sf).select(key), "site_ymd")


@query(
    "mixed_date_parse",
    """
    SELECT formid, geogr,
           CASE WHEN contains(date_text, '/') THEN CAST(concat('20', split_part(date_text, '/', 3)) AS INTEGER)
                ELSE CAST(split_part(date_text, '-', 1) AS INTEGER) END AS year,
           CASE WHEN contains(date_text, '/') THEN CAST(split_part(date_text, '/', 1) AS INTEGER)
                ELSE CAST(split_part(date_text, '-', 2) AS INTEGER) END AS month,
           CASE WHEN contains(date_text, '/') THEN CAST(split_part(date_text, '/', 2) AS INTEGER)
                ELSE CAST(split_part(date_text, '-', 3) AS INTEGER) END AS day
    FROM text_dates
    """,
    ("text_dates",),
)
def mixed_date_parse(spark, sf):
    df = views.text_dates(spark, sf).withColumns(mixed_date_parts("date_text"))
    return df.select("formid", "geogr", "year", "month", "day")


@query(
    "prefix_region",
    "SELECT substr(geogr, 1, 2) AS region, exp, count(*) AS n FROM text_dates GROUP BY ALL",
    ("text_dates",),
)
def prefix_region(spark, sf):
    df = views.text_dates(spark, sf).withColumn("region", F.substring("geogr", 1, 2))
    return rollup.count_by(df, "region", "exp")


@query(
    "annual_counts",
    """
    SELECT source, year, n, sum(n) OVER (PARTITION BY year)::BIGINT AS n_all FROM (
      SELECT source, CAST(year(obs_date) AS INTEGER) AS year, count(*) AS n FROM surveys GROUP BY ALL)
    """,
    ("surveys",),
)
def annual_counts(spark, sf):
    from pyspark.sql import Window

    df = views.surveys(spark, sf).withColumn("year", F.year("obs_date"))
    per_source = rollup.count_by(df, "source", "year")
    return per_source.withColumn("n_all", F.sum("n").over(Window.partitionBy("year")))


# --- joins --------------------------------------------------------------------------------


JOINED_SQL = f"""
facts AS (SELECT DISTINCT date_observed, place, observer, {SCORE_SQL} AS score, 1 AS seen_fact
          FROM species_rows WHERE species = 'purchase'),
joined AS (SELECT r.*, f.score, coalesce(f.seen_fact, 0) AS seen,
                  CASE WHEN f.seen_fact IS NULL THEN 1 ELSE f.score + 1 END AS score_recode
           FROM species_rows r LEFT JOIN facts f
             ON r.date_observed IS NOT DISTINCT FROM f.date_observed
            AND r.place IS NOT DISTINCT FROM f.place
            AND r.observer IS NOT DISTINCT FROM f.observer)
"""


def absence_join(spark, sf) -> DataFrame:
    rows = views.species_rows(spark, sf)
    return surveys.score_dives(rows, surveys.species_facts(rows, "purchase"))


@query(
    "left_join_absence",
    f"""
    WITH {JOINED_SQL}
    SELECT species, seen, score_recode, count(*) AS n, count(DISTINCT row_id) AS n_rows
    FROM joined GROUP BY ALL
    """,
    ("species_rows",),
)
def left_join_absence(spark, sf):
    return absence_join(spark, sf).groupBy("species", "seen", "score_recode").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_rows")
    )


FULL_SQL = """
full_rows AS (
  SELECT DISTINCT coalesce(s.form, d.formid) AS form, coalesce(s.abundance, 0) AS abundance,
         d.geogr, d.exp, d.date_text, d.btime
  FROM scores s FULL JOIN text_dates d ON s.form IS NOT DISTINCT FROM d.formid)
"""


@query(
    "full_join_fill",
    f"""
    WITH {FULL_SQL}
    SELECT form, abundance, abundance + 1 AS abundance_recode,
           CASE WHEN abundance = 0 THEN 0 ELSE 1 END AS presence,
           CASE exp WHEN 'N' THEN 0 WHEN 'E' THEN 1 END AS exp_binary, geogr
    FROM full_rows
    """,
    ("scores", "text_dates"),
)
def full_join_fill(spark, sf):
    scores = views.scores(spark, sf).select("form", "abundance")
    return surveys.fill_scores(scores, views.text_dates(spark, sf)).select(
        "form", "abundance", (F.col("abundance") + 1).alias("abundance_recode"),
        recode.present_unless_zero("abundance").alias("presence"),
        recode.binary_of("exp", "N", "E").alias("exp_binary"), "geogr",
    )


DIM_SQL = """
dim AS (
  SELECT geogid, CAST(split_part(lat, ' ', 1) AS DOUBLE) + CAST(split_part(lat, ' ', 2) AS DOUBLE) / 60 AS lat,
         -(CAST(split_part(substr(lon, 2), ' ', 1) AS DOUBLE) + CAST(split_part(lon, ' ', 2) AS DOUBLE) / 60) AS lon
  FROM site_text WHERE lat <> 'NULL')
"""


def site_dimension(spark, sf) -> DataFrame:
    return views.site_text(spark, sf).where(F.col("lat") != "NULL").select(
        "geogid",
        coords.parse_degrees_minutes("lat").alias("lat"),
        (-coords.parse_degrees_minutes("lon")).alias("lon"),
    )


@query(
    "site_coordinates",
    f"""
    WITH {DIM_SQL}
    SELECT s.site, round(d.lat, 9) AS lat, round(d.lon, 9) AS lon, s.year, s.n, s.total FROM
      (SELECT site, year, count(*) AS n, sum(num_target) AS total FROM surveys GROUP BY ALL) s
      LEFT JOIN dim d ON CAST(s.site AS VARCHAR) = d.geogid
    """,
    ("surveys", "site_text"),
)
def site_coordinates(spark, sf):
    """Coordinates joined after the rollup: the join sees one row per site and year."""
    rolled = views.surveys(spark, sf).groupBy("site", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_target").alias("total")
    )
    dim = site_dimension(spark, sf).withColumnRenamed("geogid", "code")
    joined = rolled.join(dim, F.col("site").cast("string") == F.col("code"), "left").drop("code")
    return round_all(joined, "lat", "lon", digits=9)


@query(
    "effort_catch_join",
    """
    SELECT c.year AS year_x, s.year AS year_y, CASE WHEN s.source IN ('RF', 'RO') THEN 1 ELSE 0 END AS presence,
           count(*) AS n
    FROM catches c LEFT JOIN surveys s ON c.haul = s.l_orderkey GROUP BY ALL
    """,
    ("catches", "surveys"),
)
def effort_catch_join(spark, sf):
    """Effort records with their catches; hauls without a catch row are absences."""
    effort = views.catches(spark, sf).select("haul", F.col("year").alias("year_x"))
    caught = views.surveys(spark, sf).select(
        F.col("l_orderkey").alias("haul"), F.col("year").alias("year_y"), "source"
    )
    joined = effort.join(caught, "haul", "left")
    flag = F.when(F.col("source").isin("RF", "RO"), 1).otherwise(0)
    return rollup.count_by(joined.withColumn("presence", flag), "year_x", "year_y", "presence")


SOURCES = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query(
    "year_spine_join",
    """
    SELECT y.year, round(avg(num_target) FILTER (WHERE source = 'AF'), 6) AS "AF",
           round(avg(num_target) FILTER (WHERE source = 'AO'), 6) AS "AO",
           round(avg(num_target) FILTER (WHERE source = 'NF'), 6) AS "NF",
           round(avg(num_target) FILTER (WHERE source = 'NO'), 6) AS "NO",
           round(avg(num_target) FILTER (WHERE source = 'RF'), 6) AS "RF",
           round(avg(num_target) FILTER (WHERE source = 'RO'), 6) AS "RO"
    FROM (SELECT CAST(unnest(generate_series(1993, 2003)) AS INTEGER) AS year) y
    LEFT JOIN surveys s ON s.year = y.year GROUP BY y.year
    """,
    ("surveys",),
)
def year_spine_join(spark, sf):
    wide = views.surveys(spark, sf).groupBy("year").pivot("source", SOURCES).agg(F.avg("num_target"))
    spine = encode.year_spine(spark, 1993, 2003)
    return round_all(spine.join(wide, "year", "left"), *SOURCES)


# --- aggregations -------------------------------------------------------------------------


@query(
    "site_year_rollup",
    """
    SELECT source, year, lat, lon, num_visits, round(mean_count, 6) AS mean_count, median_count, presence,
           round(strict_mean, 6) AS strict_mean
    FROM (SELECT source, year, lat, lon, count(*) AS num_visits, avg(num_target) AS mean_count,
                 median(num_target) AS median_count,
                 max(CASE WHEN num_target > 0 THEN 1 ELSE 0 END) AS presence,
                 CASE WHEN count(num_target) = count(*) THEN avg(num_target) END AS strict_mean
          FROM surveys GROUP BY source, year, lat, lon)
    """,
    ("surveys",),
)
def site_year_rollup(spark, sf):
    flagged = views.surveys(spark, sf).withColumn("presence", recode.presence("num_target"))
    df = flagged.groupBy("source", "year", "lat", "lon").agg(
        F.count(F.lit(1)).alias("num_visits"),
        F.avg("num_target").alias("mean_count"),
        F.median("num_target").alias("median_count"),
        missing.strict_max("presence").alias("presence"),
        missing.strict_avg("num_target").alias("strict_mean"),
    )
    return round_all(df, "mean_count", "strict_mean")


@query(
    "site_year_presence",
    """
    SELECT lat, lon, year, count(*) AS num_visits, 1 AS presence FROM surveys
    WHERE num_target > 0 AND year < 1999 GROUP BY ALL
    """,
    ("surveys",),
)
def site_year_presence(spark, sf):
    df = views.surveys(spark, sf).where((F.col("num_target") > 0) & (F.col("year") < 1999))
    return df.groupBy("lat", "lon", "year").agg(
        F.count(F.lit(1)).alias("num_visits"), F.lit(1).alias("presence")
    )


@query(
    "source_sample_sizes",
    "SELECT source, count(*) AS n, count(*) FILTER (WHERE mean_count IS NOT NULL) AS n_counts FROM site_years GROUP BY source",
    ("site_years",),
)
def source_sample_sizes(spark, sf):
    df = views.surveys(spark, sf).groupBy("source", "year", "lat", "lon").agg(
        F.avg("num_target").alias("mean_count")
    )
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("mean_count").alias("n_counts")
    )


@query(
    "sighting_frequency",
    """
    SELECT source, year, round(avg(CASE WHEN num_target > 0 THEN 1 ELSE 0 END), 6) AS mean_presence, count(*) AS n
    FROM deduped GROUP BY source, year
    """,
    ("deduped",),
)
def sighting_frequency(spark, sf):
    """Flagship: one survey per site and day, then mean presence by source and year."""
    df = views.deduped(spark, sf).withColumn("presence", recode.presence("num_target"))
    return round_all(rollup.sighting_frequency(df, ["source", "year"]), "mean_presence")


@query(
    "missingness_by_year",
    f"""
    WITH {JOINED_SQL}
    SELECT date_observed::VARCHAR AS day, count(*) AS n, count(*) FILTER (WHERE score_recode IS NULL) AS nas,
           round(count(*) FILTER (WHERE score_recode IS NULL) / count(*), 6) AS prop_na
    FROM joined GROUP BY ALL
    """,
    ("species_rows",),
)
def missingness_by_year(spark, sf):
    df = absence_join(spark, sf).withColumn("day", F.col("date_observed").cast("string"))
    return round_all(rollup.missingness(df, ["day"], "score_recode"), "prop_na")


@query(
    "distinct_rows",
    "SELECT DISTINCT site, source, year, num_target FROM surveys",
    ("surveys",),
)
def distinct_rows(spark, sf):
    return views.surveys(spark, sf).select("site", "source", "year", "num_target").distinct()


@query(
    "distinct_keep_first",
    """
    SELECT * EXCLUDE (rn, date_observed), CAST(date_observed AS VARCHAR) AS day FROM (
      SELECT *, row_number() OVER (PARTITION BY date_observed, place, observer ORDER BY row_id) AS rn
      FROM species_rows) WHERE rn = 1
    """,
    ("species_rows",),
)
def distinct_keep_first(spark, sf):
    df = dedup.keep_first(views.species_rows(spark, sf), surveys.DIVE, ["row_id"])
    return df.withColumn("day", F.col("date_observed").cast("string")).drop("date_observed")


@query(
    "model_dimensions",
    """
    SELECT count(*) AS n_rows, count(DISTINCT site) + max((site IS NULL)::BIGINT) AS n_site,
           count(DISTINCT year) + max((year IS NULL)::BIGINT) AS n_year,
           count(DISTINCT source) + max((source IS NULL)::BIGINT) AS n_source,
           count(DISTINCT lat) + max((lat IS NULL)::BIGINT) AS n_lat
    FROM surveys
    """,
    ("surveys",),
)
def model_dimensions(spark, sf):
    return rollup.cardinalities(
        views.surveys(spark, sf),
        {"n_site": "site", "n_year": "year", "n_source": "source", "n_lat": "lat"},
    )


@query(
    "effort_summary",
    """
    SELECT source, round(avg(coalesce(area, bottom_time)), 6) AS mean,
           round(stddev_samp(coalesce(area, bottom_time)), 6) AS sd, count(coalesce(area, bottom_time)) AS n
    FROM surveys GROUP BY source
    """,
    ("surveys",),
)
def effort_summary(spark, sf):
    df = encode.effort_summary(views.surveys(spark, sf), "source", F.coalesce("area", "bottom_time"))
    return round_all(df, "mean", "sd")


# --- windows, encoding, order -------------------------------------------------------------


@query(
    "dedup_site_day",
    """
    SELECT * EXCLUDE (obs_date), CAST(obs_date AS VARCHAR) AS day FROM deduped
    """,
    ("deduped",),
)
def dedup_site_day(spark, sf):
    df = views.deduped(spark, sf)
    return df.withColumn("day", F.col("obs_date").cast("string")).drop("obs_date")


COMMUNITY_SQL = f"""
facts AS (SELECT DISTINCT date_observed, place, observer, {SCORE_SQL} AS score, 1 AS seen_fact
          FROM species_rows WHERE species = 'purchase'),
first_fact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_observed, place, observer
                 ORDER BY score NULLS LAST) AS fr FROM facts) WHERE fr = 1),
per_observer AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_observed, place, observer
                 ORDER BY row_id) AS rn FROM species_rows) WHERE rn = 1),
usable AS (SELECT p.*, f.score, coalesce(f.seen_fact, 0) AS seen,
             CASE WHEN f.seen_fact IS NULL THEN 1 ELSE f.score + 1 END AS score_recode,
             CASE WHEN f.score > 0 THEN 1 ELSE 0 END AS presence
           FROM per_observer p LEFT JOIN first_fact f USING (date_observed, place, observer)
           WHERE score_recode IS NOT NULL AND max_depth IS NOT NULL),
community AS (SELECT *, CAST(num_surveys > 1 AS INTEGER) AS multiple_surveys FROM (
           SELECT *, count(*) OVER (PARTITION BY date_observed, place) AS num_surveys,
             row_number() OVER (PARTITION BY date_observed, place ORDER BY score_recode DESC, row_id) AS pick
           FROM usable) WHERE pick = 1)
"""


@query(
    "dedup_two_level",
    f"""
    WITH {COMMUNITY_SQL}
    SELECT CAST(date_observed AS VARCHAR) AS day, place, row_id, observer, score, score_recode, presence,
           num_surveys, multiple_surveys FROM community
    """,
    ("species_rows",),
)
def dedup_two_level(spark, sf):
    return surveys.community_dives(views.species_rows(spark, sf), "purchase", ["row_id"]).select(
        F.col("date_observed").cast("string").alias("day"), "place", "row_id", "observer", "score",
        "score_recode", "presence", "num_surveys", "multiple_surveys",
    )


@query(
    "per_group_row_number",
    """
    SELECT source, l_orderkey, l_linenumber, l_partkey, site,
           row_number() OVER (PARTITION BY source ORDER BY obs_date, l_orderkey, l_linenumber, l_partkey, site) AS row
    FROM surveys
    """,
    ("surveys",),
)
def per_group_row_number(spark, sf):
    df = views.surveys(spark, sf).select(
        "source", "obs_date", "l_orderkey", "l_linenumber", "l_partkey", "site"
    )
    out = ranks.numbered_within(
        df, ["source"], "obs_date", ["l_orderkey", "l_linenumber", "l_partkey", "site"]
    )
    return out.drop("obs_date")


@query(
    "dense_ids",
    """
    SELECT site_code, site_id, n FROM (
      SELECT site_code, CASE WHEN site_code IS NOT NULL THEN dense_rank() OVER (ORDER BY site_code NULLS LAST) END AS site_id,
             count(*) AS n
      FROM (SELECT CASE WHEN lat IS NOT NULL THEN concat('s', CAST(l_partkey AS VARCHAR)) END AS site_code FROM surveys)
      GROUP BY site_code)
    """,
    ("surveys",),
)
def dense_ids(spark, sf):
    code = F.when(F.col("lat").isNotNull(), F.concat(F.lit("s"), F.col("l_partkey").cast("string")))
    df = views.surveys(spark, sf).select(code.alias("site_code"))
    return rollup.count_by(ranks.with_dense_id(df, "site_code", "site_id"), "site_code", "site_id")


@query(
    "zscore_covariates",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, site, source,
           round((bottom_time - avg(bottom_time) OVER ()) / stddev_samp(bottom_time) OVER (), 6) AS time_z,
           round((num_target - avg(num_target) OVER (PARTITION BY source))
                 / stddev_samp(num_target) OVER (PARTITION BY source), 6) AS target_z
    FROM surveys
    """,
    ("surveys",),
)
def zscore_covariates(spark, sf):
    df = encode.zscore_pooled(views.surveys(spark, sf), {"time_z": "bottom_time"})
    df = encode.zscore_by(df, "source", {"target_z": "num_target"})
    return round_all(df, "time_z", "target_z").select(
        "l_orderkey", "l_linenumber", "l_partkey", "site", "source", "time_z", "target_z"
    )


@query(
    "effort_design",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, site, presence, effort_type,
           round(scaled_effort, 6) + 0e0 AS scaled_effort, round(time_term, 6) + 0e0 AS time_term,
           round(area_term, 6) + 0e0 AS area_term
    FROM presence_design
    """,
    ("presence_design",),
)
def effort_design(spark, sf):
    df = views.surveys(spark, sf).withColumns(
        {"time": F.col("bottom_time"), "presence": recode.presence("num_target")}
    )
    df = round_all(encode.effort_design(df), "scaled_effort", "time_term", "area_term")
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "site", "presence", "effort_type",
        "scaled_effort", "time_term", "area_term",
    )


@query(
    "ordered_output",
    "SELECT year, source, sum(num_target) AS total, count(*) AS n FROM surveys GROUP BY ALL ORDER BY year, total DESC, source",
    ("surveys",),
)
def ordered_output(spark, sf):
    df = views.surveys(spark, sf).groupBy("year", "source").agg(
        F.sum("num_target").alias("total"), F.count(F.lit(1)).alias("n")
    )
    return df.orderBy("year", F.desc("total"), "source")


@query(
    "year_index",
    "SELECT DISTINCT source, year, year - 1994 AS tt FROM surveys",
    ("surveys",),
)
def year_index(spark, sf):
    return encode.year_index(views.surveys(spark, sf), ["source"], views.FIRST_YEAR - 1)


@query(
    "regime_by_year",
    """
    SELECT y.year, CASE WHEN y.year <= 1997 THEN 0 WHEN y.year = 1998 THEN 1 ELSE 2 END AS regime,
           CAST(EXISTS (SELECT 1 FROM surveys s WHERE s.year = y.year) AS INTEGER) AS surveyed
    FROM (SELECT CAST(unnest(generate_series(1993, 2003)) AS INTEGER) AS year) y
    """,
    ("surveys",),
)
def regime_by_year(spark, sf):
    regimes = [(0, None, 1997), (1, 1998, 1998), (2, 1999, None)]
    return encode.regime_by_year(views.surveys(spark, sf), regimes, 1993, 2003)


@query(
    "isolated_years",
    """
    SELECT site, year, CAST(coalesce(year - lag(year) OVER w, 0) <> 1
                        AND coalesce(lead(year) OVER w - year, 0) <> 1 AS INTEGER) AS isolated
    FROM (SELECT DISTINCT l_partkey AS site, year FROM surveys) WINDOW w AS (PARTITION BY site ORDER BY year)
    """,
    ("surveys",),
)
def isolated_years(spark, sf):
    df = views.surveys(spark, sf).select(F.col("l_partkey").alias("site"), "year")
    return encode.isolated_years(df, ["site"])


# --- set operations -----------------------------------------------------------------------


@query(
    "union_sources",
    """
    SELECT origin, year, count(*) AS n, count(lat) AS n_lat, count(depth) AS n_depth, count(area) AS n_area
    FROM (SELECT 'dives' AS origin, year, lat, NULL::DOUBLE AS depth, area FROM surveys
          UNION ALL SELECT 'catches', year, lat_deg, max_depth, NULL FROM catches
          UNION ALL SELECT 'species', CAST(year(date_observed) AS INTEGER), NULL, max_depth, NULL FROM species_rows)
    GROUP BY ALL
    """,
    ("surveys", "catches", "species_rows"),
)
def union_sources(spark, sf):
    a = views.surveys(spark, sf).select(F.lit("dives").alias("origin"), "year", "lat", "area")
    b = views.catches(spark, sf).select(
        F.lit("catches").alias("origin"), "year", F.col("lat_deg").alias("lat"), F.col("max_depth").alias("depth")
    )
    c = views.species_rows(spark, sf).select(
        F.lit("species").alias("origin"), F.year("date_observed").alias("year"), F.col("max_depth").alias("depth")
    )
    return combine.union_sources(a, b, c).groupBy("origin", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count("lat").alias("n_lat"),
        F.count("depth").alias("n_depth"), F.count("area").alias("n_area"),
    )


@query(
    "union_distinct",
    """
    SELECT lat, lon, year FROM surveys UNION
    SELECT lat_deg + lat_min / 60, -(lon_deg + lon_min / 60), year FROM catches
    """.replace("lat_deg + lat_min / 60", "round(lat_deg + lat_min / 60, 9)").replace(
        "-(lon_deg + lon_min / 60)", "round(-(lon_deg + lon_min / 60), 9)"
    ),
    ("surveys", "catches"),
)
def union_distinct(spark, sf):
    a = views.surveys(spark, sf).select("lat", "lon", "year")
    b = views.catches(spark, sf).select(
        rounded(coords.degrees_minutes("lat_deg", "lat_min"), 9).alias("lat"),
        rounded(-coords.degrees_minutes("lon_deg", "lon_min"), 9).alias("lon"),
        "year",
    )
    return combine.union_sources(a, b).distinct()
