"""End-to-end chains, each as one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import recode
from tidegrid.functions.links import inv_logit
from tidegrid.operators import combine, encode, grid, polygons, posterior, rollup
from tidegrid.plans import areas, designs, surveys, trends
from tidegrid.sources import tables
from tidegrid.workload import spatial, tabular, views
from tidegrid.workload.draws import states
from tidegrid.workload.oracle_views import albers_sql, cell_sql
from tidegrid.workload.registry import query, round_all

DAY_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "site"]


def dated(spark, sf):
    return views.surveys(spark, sf).withColumns(
        {"month": F.month("obs_date"), "day": F.dayofmonth("obs_date"), "num_count": F.col("num_target"),
         "stat_area": F.when(~F.col("source").startswith("A"), F.col("site") % 30 + 1), "sub_area": F.col("l_linenumber"),
         "num_quadrats": F.col("area"), "depth": (F.col("l_partkey") % 43).cast("double"), "site": F.col("site").cast("string")}
    )


DIVE_SQL = """
dated_surveys AS (SELECT *, month(obs_date) AS mon, day(obs_date) AS dom, CASE WHEN num_target > 0 THEN 1 ELSE 0 END AS presence,
                    CASE WHEN left(source, 1) <> 'A' THEN site % 30 + 1 END AS stat_area FROM surveys),
best_dives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left(source, 1), year, mon, dom, lat, lon
             ORDER BY presence DESC, l_orderkey, l_linenumber, l_partkey, CAST(site AS VARCHAR)) AS rn
           FROM dated_surveys WHERE (left(source, 1) = 'A') OR (left(source, 1) = 'N' AND num_target IS NOT NULL)) WHERE rn = 1),
dives AS (
  SELECT CASE left(source, 1) WHEN 'A' THEN 'flagged' ELSE 'counted' END AS source, year, CAST(site AS VARCHAR) AS site,
         presence, num_target, lat, lon, stat_area, l_linenumber AS sub_area, area AS num_quadrats, bottom_time, l_partkey % 43 AS depth FROM best_dives
  UNION ALL SELECT 'index', year, concat(CAST(site AS VARCHAR), '_', CASE source WHEN 'RF' THEN 'A' ELSE 'B' END),
         presence, num_target, lat, lon, stat_area, l_linenumber, area, bottom_time, l_partkey % 43 FROM dated_surveys WHERE left(source, 1) = 'R' AND num_target IS NOT NULL)
"""


@query(
    "dive_survey_table",
    """
    WITH """ + DIVE_SQL + """
    SELECT source, year, count(*) AS n, sum(presence)::BIGINT AS n_present, sum(num_target) AS total,
           count(lat) AS n_located, count(DISTINCT site) AS n_sites, count(DISTINCT (stat_area, sub_area)) FILTER (WHERE stat_area IS NOT NULL) AS n_areas,
           round(sum(num_quadrats), 6) AS quadrats, round(sum(bottom_time), 6) AS minutes, round(avg(depth), 6) AS mean_depth
    FROM dives GROUP BY source, year
    """,
    ("surveys",),
)
def dive_survey_table(spark, sf):
    out = dive_rows(spark, sf).groupBy("source", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("presence").alias("n_present"),
        F.sum("num_count").alias("total"), F.count("lat").alias("n_located"),
        F.count_distinct("site").alias("n_sites"), F.count_distinct("stat_area", "sub_area").alias("n_areas"),
        F.sum("num_quadrats").alias("quadrats"), F.sum("bottom_time").alias("minutes"), F.avg("depth").alias("mean_depth"),
    )
    return round_all(out, "quadrats", "minutes", "mean_depth")


def dive_rows(spark, sf):
    df = dated(spark, sf)
    of = lambda prefix: df.where(F.col("source").startswith(prefix))
    return surveys.dive_table(
        of("A").withColumn("presence", recode.presence("num_count")),
        of("N"),
        {"A": of("RF"), "B": of("RO")},
        DAY_TIES,
    )


SMALL_SQL = """
small AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY site_ymd) AS n,
                        row_number() OVER (PARTITION BY site_ymd ORDER BY presence DESC, l_orderkey, l_linenumber, l_partkey, site) AS rn
    FROM (SELECT *, concat(location, '_', CASE WHEN l_partkey % 3 > 0 THEN CAST(obs_date AS VARCHAR) ELSE CAST(year AS VARCHAR) END) AS site_ymd
          FROM (SELECT *, concat(coalesce(CAST(lat AS VARCHAR), 'NA'), '_', coalesce(CAST(lon AS VARCHAR), 'NA')) AS location,
                       CASE WHEN num_target > 0 THEN 1 ELSE 0 END AS presence
                FROM surveys WHERE source NOT IN ('AF') AND NOT regexp_matches(source, '^R.*F$'))))
  WHERE rn = 1 AND year > 1995)
"""


@query(
    "small_source_table",
    "WITH " + SMALL_SQL + """
    SELECT site_ymd, source, year, presence, n, CAST(n > 1 AS INTEGER) AS multiple_surveys,
           CASE WHEN year <= 1997 THEN 0 ELSE 1 END AS after_start,
           CASE WHEN year IN (1998, 1999) THEN 1 ELSE 0 END AS during
    FROM small
    """,
    ("surveys",),
)
def small_source_table(spark, sf):
    return small_rows(spark, sf).select(
        "site_ymd", "source", "year", "presence", "n", "multiple_surveys", "after_start", "during"
    )


def small_rows(spark, sf):
    df = views.surveys(spark, sf).withColumns(
        {
            "date": F.when(F.col("l_partkey") % 3 > 0, F.col("obs_date").cast("string")),
            "presence": recode.presence("num_target"),
        }
    )
    return surveys.small_sources(df, ["AF"], "^R.*F$", DAY_TIES).where(F.col("year") > 1995)


@query(
    "community_dive_table",
    f"""
    WITH {tabular.COMMUNITY_SQL}
    SELECT CAST(year(date_observed) AS INTEGER) AS year, place, count(*) AS n, sum(presence)::BIGINT AS n_present,
           sum(multiple_surveys)::BIGINT AS n_multiple, max(score_recode) AS top_score
    FROM community WHERE year(date_observed) BETWEEN 2001 AND 2024 GROUP BY ALL
    """,
    ("species_rows",),
)
def community_dive_table(spark, sf):
    dives = surveys.community_dives(views.species_rows(spark, sf), "purchase", ["row_id"])
    dives = dives.withColumn("year", F.year("date_observed")).where(F.col("year").between(2001, 2024))
    return dives.groupBy("year", "place").agg(
        F.count(F.lit(1)).alias("n"), F.sum("presence").alias("n_present"),
        F.sum("multiple_surveys").alias("n_multiple"), F.max("score_recode").alias("top_score"),
    )


TWO_FILE_SQL = """
dated AS (SELECT *, CAST(CASE WHEN contains(date_text, '/') THEN concat('20', split_part(date_text, '/', 3))
                              ELSE split_part(date_text, '-', 1) END AS INTEGER) AS year,
            CAST(CASE WHEN contains(date_text, '/') THEN split_part(date_text, '/', 1) ELSE split_part(date_text, '-', 2) END AS INTEGER) AS mon,
            CAST(CASE WHEN contains(date_text, '/') THEN split_part(date_text, '/', 2) ELSE split_part(date_text, '-', 3) END AS INTEGER) AS dom
          FROM text_dates WHERE regexp_matches(geogr, '^1')),
full_rows AS (SELECT DISTINCT coalesce(s.form, d.formid) AS form, coalesce(s.abundance, 0) AS abundance, geogr, exp, btime, year,
                CASE WHEN d.formid IS NOT NULL THEN concat(geogr, '_', dom, '_', mon, '_', year) END AS site_ymd
              FROM (SELECT * FROM scores WHERE regexp_matches(geozone, '^1')) s FULL JOIN dated d ON s.form = d.formid),
two_file AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY site_ymd) AS num_surveys,
               row_number() OVER (PARTITION BY site_ymd ORDER BY abundance DESC, form) AS rn FROM full_rows) WHERE rn = 1)
"""


@query(
    "two_file_survey_table",
    f"""
    WITH {TWO_FILE_SQL}
    SELECT site_ymd, form, year, abundance, abundance + 1 AS abundance_recode,
           CASE WHEN abundance = 0 THEN 0 ELSE 1 END AS presence,
           CASE exp WHEN 'N' THEN 0 WHEN 'E' THEN 1 END AS exp_binary, num_surveys,
           CAST(num_surveys > 1 AS INTEGER) AS multiple_surveys,
           CASE WHEN year < 2014 OR year > 2015 THEN 0 ELSE 1 END AS during, substr(geogr, 1, 2) AS region
    FROM two_file
    """,
    ("scores", "text_dates"),
)
def two_file_survey_table(spark, sf):
    out = surveys.two_file_survey(views.scores(spark, sf), views.text_dates(spark, sf), "^1")
    return out.select(
        "site_ymd", "form", "year", "abundance", "abundance_recode", "presence", "exp_binary",
        "num_surveys", "multiple_surveys", "during", "region",
    )


def community_scores(spark, sf):
    """Dives with a 7-level score, as the lowest count of its level, at the coordinates of their place."""
    dives = surveys.community_dives(views.species_rows(spark, sf), "purchase", ["row_id"])
    counted = dives.select(
        F.year("date_observed").alias("year"), F.col("place").cast("string").alias("place"), "presence",
        recode.score_to_count("score_recode", recode.SEVEN_LEVEL_COUNTS, 1).cast("double").alias("count"),
    )
    dim = tabular.site_dimension(spark, sf)
    return counted.join(dim, counted.place == dim.geogid, "left").select("lat", "lon", "year", "count", "presence")


def location_inputs(spark, sf):
    df = views.surveys(spark, sf).withColumns(
        {"count": F.col("num_target"), "presence": recode.presence("num_target")}
    )
    forms = surveys.fill_scores(
        views.scores(spark, sf).select("form", "abundance"), views.text_dates(spark, sf)
    ).withColumns(
        {
            "count": recode.score_to_count("abundance", recode.FIVE_LEVEL_COUNTS).cast("double"),
            "presence": recode.present_unless_zero("abundance"),
            "site_code": F.substring("geogr", 4, 2).try_cast("int").cast("string"),
            "year": F.when(F.col("form") >= 10000000, None).otherwise(F.lit(2024)),
        }
    )
    scored = forms.join(tabular.site_dimension(spark, sf), forms.site_code == F.col("geogid"), "left")
    of = lambda *names: df.where(F.col("source").isin(*names))
    caught = surveys.bycatch_presence(views.catches(spark, sf), "TGT").select("source", "year", "lat", "lon")
    return {
        "counted": of("AF", "AO"),
        "scored": scored.select("lat", "lon", "year", "count", "presence"),
        "scored7": community_scores(spark, sf),
        "early": of("NF").where(F.col("year") < 1998),
        "strict": of("NO", "RF", "NF").where((F.col("source") != "NF") | (F.col("year") >= 1998)),
        "sightings": caught,
        "uncounted": of("RO"),
    }


@query(
    "location_rollup",
    f"""
    WITH {tabular.DIM_SQL}, {tabular.FULL_SQL}, {tabular.COMMUNITY_SQL},
    s AS (SELECT *, CASE WHEN num_target > 0 THEN 1 ELSE 0 END AS presence FROM surveys),
    scored7 AS (SELECT d.lat, d.lon, CAST(year(date_observed) AS INTEGER) AS year, presence,
                  CASE score_recode WHEN 1 THEN 0e0 WHEN 2 THEN 1 WHEN 3 THEN 11 WHEN 4 THEN 26 WHEN 5 THEN 51 WHEN 6 THEN 101 WHEN 7 THEN 1001 END AS count
                FROM community c LEFT JOIN dim d ON CAST(c.place AS VARCHAR) = d.geogid),
    scored AS (SELECT d.lat, d.lon, CASE WHEN form < 10000000 THEN 2024 END AS year,
                 CASE abundance WHEN 0 THEN 0e0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 11 WHEN 4 THEN 101 END AS count,
                 CASE WHEN abundance = 0 THEN 0 ELSE 1 END AS presence
               FROM full_rows f LEFT JOIN dim d ON CAST(TRY_CAST(substr(f.geogr, 4, 2) AS INTEGER) AS VARCHAR) = d.geogid),
    caught AS (SELECT concat(fishery, '_catch') AS source, year, lat_deg + lat_min / 60 AS lat,
                 CASE WHEN fishery IN ('crab', 'prawn') THEN lon_deg + lon_min / 60 ELSE -(lon_deg + lon_min / 60) END AS lon
               FROM catches WHERE species_code = 'TGT' AND (fishery <> 'longline' OR catch_count > 0)),
    parts AS (
      SELECT source, year, lat, lon, count(*) AS num_visits, avg(num_target) AS mean_count, median(num_target) AS median_count,
             max(presence) AS presence FROM s WHERE source IN ('AF', 'AO') GROUP BY source, year, lat, lon
      UNION ALL SELECT 'scored', year, lat, lon, count(*), avg(count), median(count), max(presence) FROM scored GROUP BY year, lat, lon
      UNION ALL SELECT 'scored7', year, lat, lon, count(*), avg(count), median(count), max(presence) FROM scored7 GROUP BY year, lat, lon
      UNION ALL SELECT 'early', year, lat, lon, count(*), NULL, NULL, 1 FROM s
                WHERE source = 'NF' AND year < 1998 AND presence = 1 GROUP BY year, lat, lon
      UNION ALL SELECT source, year, lat, lon, count(*), CASE WHEN count(num_target) = count(*) THEN avg(num_target) END,
                median(num_target), max(presence) FROM s WHERE source IN ('NO', 'RF') OR (source = 'NF' AND year >= 1998) GROUP BY source, year, lat, lon
      UNION ALL SELECT source, year, lat, lon, count(*), 1, 1, 1 FROM caught GROUP BY source, year, lat, lon
      UNION ALL SELECT source, year, lat, lon, count(*), NULL, NULL, max(presence) FROM s WHERE source = 'RO' GROUP BY source, year, lat, lon)
    SELECT source, year, round(lat, 8) AS lat, round(lon, 8) AS lon, num_visits, round(mean_count, 6) AS mean_count,
           median_count, presence FROM (SELECT DISTINCT * FROM parts)
    """,
    ("surveys", "scores", "text_dates", "site_text", "catches", "species_rows"),
)
def location_rollup(spark, sf):
    out = surveys.location_rollup(**location_inputs(spark, sf))
    return round_all(round_all(out, "lat", "lon", digits=8), "mean_count").select(
        "source", "year", "lat", "lon", "num_visits", "mean_count", "median_count", "presence"
    )


@query(
    "bycatch_tables",
    """
    SELECT kind, source, year, count(*) AS n, sum(presence)::BIGINT AS n_present, round(avg(depth), 6) AS mean_depth FROM (
      SELECT 'presence_only' AS kind, concat(fishery, '_catch') AS source, year, 1 AS presence,
             CASE WHEN fishery IN ('crab', 'prawn') AND depth_unit = 'F' THEN max_depth / 3.28084e0 ELSE max_depth END AS depth
      FROM catches WHERE species_code = 'TGT' AND (fishery <> 'longline' OR catch_count > 0)
      UNION ALL SELECT 'presence_absence', 'longline_catch', year, CASE WHEN catch_count = 0 THEN 0 ELSE 1 END, max_depth
      FROM catches WHERE species_code = 'TGT' AND fishery = 'longline') GROUP BY kind, source, year
    """,
    ("catches",),
)
def bycatch_tables(spark, sf):
    df = views.catches(spark, sf)
    only = surveys.bycatch_presence(df, "TGT").withColumn("kind", F.lit("presence_only"))
    both = surveys.catch_presence_absence(df, "TGT", "longline").withColumn("kind", F.lit("presence_absence"))
    out = only.unionByName(both).groupBy("kind", "source", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("presence").alias("n_present"), F.avg("depth").alias("mean_depth")
    )
    return round_all(out, "mean_depth")


SPINE = (1995, 2024)
PROGRAMMES_SQL = f"""
{TWO_FILE_SQL}, {tabular.COMMUNITY_SQL}, {SMALL_SQL}, {DIVE_SQL},
programmes AS (
  SELECT year, CASE WHEN abundance = 0 THEN 0 ELSE 1 END AS presence, geogr AS site, 'forms' AS source, 'forms' AS source_group, btime AS time, NULL::DOUBLE AS area FROM two_file
  UNION ALL SELECT CAST(year(date_observed) AS INTEGER), presence, CAST(place AS VARCHAR), 'community', 'community', max_depth, NULL FROM community
  UNION ALL SELECT year, presence, location, source, 'small', bottom_time, area FROM small
  UNION ALL SELECT year, presence, coalesce(CAST(stat_area AS VARCHAR), concat(coalesce(CAST(lat AS VARCHAR), 'NA'), '_', coalesce(CAST(lon AS VARCHAR), 'NA'))),
                   source, source, NULL, num_quadrats FROM dives)
"""


@query(
    "presence_design_table",
    f"""
    WITH {PROGRAMMES_SQL},
    scaled AS (SELECT *, (time - avg(time) OVER ()) / stddev_samp(time) OVER () AS z_time, (area - avg(area) OVER ()) / stddev_samp(area) OVER () AS z_area FROM programmes),
    design AS (SELECT *, dense_rank() OVER (ORDER BY source_group) AS source_id, CASE WHEN site IS NOT NULL THEN dense_rank() OVER (ORDER BY site NULLS LAST) END AS site_id
               FROM scaled WHERE CASE WHEN area IS NOT NULL THEN z_area ELSE z_time END IS NOT NULL)
    SELECT s.year, s.year - {SPINE[0] - 1} AS tt, CASE WHEN s.year <= 1997 THEN 0 WHEN s.year = 1998 THEN 1 ELSE 2 END AS regime,
           source_group, source, source_id, count(source) AS n, sum(presence)::BIGINT AS n_present, sum(site_id)::BIGINT AS site_id_sum,
           count(area) AS n_by_area, round(avg(coalesce(z_time, 0)), 7) + 0e0 AS mean_time, round(avg(coalesce(z_area, 0)), 7) + 0e0 AS mean_area
    FROM (SELECT CAST(unnest(generate_series({SPINE[0]}, {SPINE[1]})) AS INTEGER) AS year) s LEFT JOIN design d ON d.year = s.year GROUP BY ALL
    """,
    ("surveys", "scores", "text_dates", "species_rows"),
)
def presence_design_table(spark, sf):
    """Surveys of four programmes by source and year: on the year spine, with each year's regime."""
    rows = surveys.programmes(
        surveys.two_file_survey(views.scores(spark, sf), views.text_dates(spark, sf), "^1"),
        surveys.community_dives(views.species_rows(spark, sf), "purchase", ["row_id"]),
        small_rows(spark, sf), dive_rows(spark, sf),
    )
    out = designs.presence_design(rows, SPINE[0] - 1, {"source_group": "source_id", "site": "site_id"})
    out = out.groupBy("source_group", "source", "source_id", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("presence").alias("n_present"), F.sum("site_id").alias("site_id_sum"),
        F.count("area").alias("n_by_area"), F.avg("time_term").alias("mean_time"), F.avg("area_term").alias("mean_area"),
    )
    spine = encode.year_spine(spark, *SPINE).withColumns(
        {"tt": F.col("year") - (SPINE[0] - 1), "regime": recode.regime_of("year", [(0, None, 1997), (1, 1998, 1998), (2, 1999, None)])}
    )
    out = spine.join(out, "year", "left").fillna({"n": 0, "n_by_area": 0})
    # a year without surveys has no terms; SQL's mean over its empty row is that of zeros
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("mean_time", "mean_area")})
    return round_all(out, "mean_time", "mean_area", digits=7)


@query(
    "abundance_design_table",
    """
    WITH d AS (SELECT s.*, coalesce(area, bottom_time) AS effort FROM deduped s WHERE coalesce(area, bottom_time) IS NOT NULL),
    z AS (SELECT *, (effort - avg(effort) OVER w) / stddev_samp(effort) OVER w AS effort_z,
                 dense_rank() OVER (PARTITION BY source ORDER BY site) AS site_id, dense_rank() OVER (PARTITION BY source ORDER BY year) AS year_id
          FROM d WINDOW w AS (PARTITION BY source))
    SELECT source, year, year - 1994 AS tt, year_id, count(*) AS n, sum(site_id)::BIGINT AS site_id_sum,
           sum(multiple_surveys)::BIGINT AS n_multiple, round(avg(effort_z), 7) + 0e0 AS mean_effort, round(avg(num_target), 7) + 0e0 AS mean_count
    FROM z GROUP BY ALL
    """,
    ("deduped",),
)
def abundance_design_table(spark, sf):
    df = views.deduped(spark, sf).withColumn("effort", F.coalesce("area", "bottom_time"))
    df = df.where(F.col("effort").isNotNull())
    out = designs.abundance_design(
        df, "source", {"effort_z": "effort"}, views.FIRST_YEAR - 1,
        {"site": "site_id", "year": "year_id"},
    )
    out = out.groupBy("source", "year", "tt", "year_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("site_id").alias("site_id_sum"),
        F.sum("multiple_surveys").alias("n_multiple"),
        F.avg("effort_z").alias("mean_effort"), F.avg("num_target").alias("mean_count"),
    )
    return round_all(out, "mean_effort", "mean_count", digits=7)


# --- space --------------------------------------------------------------------------------

AREA_REGIMES = [("pre", None, 1997), ("post", 1999, None)]
X, Y = albers_sql("lon", "lat")
LISTED_SQL = "SELECT 1 FROM orders o WHERE o.o_orderkey = s.l_orderkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'P'"


def listed(spark, sf):
    """Records to leave out, keyed on a stable column."""
    orders = tables.read_table(spark, sf, "orders")
    bad = orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"))
    return bad.select(F.col("o_orderkey").alias("l_orderkey"))


def clean(spark, sf, df):
    water = polygons.literal_edges(spark, views.WATER)
    return areas.clean_points(
        df, views.CRS, water, spatial.STRIP_DEG, AREA_REGIMES, listed(spark, sf), ["l_orderkey"]
    )


CLEAN_SQL = f"""
{spatial.INSIDE_SQL},
cleaned AS (SELECT *, {X} AS x, {Y} AS y,
              CASE WHEN year <= 1997 THEN 'pre' WHEN year >= 1999 THEN 'post' END AS regime
            FROM surveys s JOIN inside USING (lat, lon) WHERE NOT EXISTS ({LISTED_SQL}))
"""


CAUGHT_SQL = """
caught AS (SELECT year, lat_deg + lat_min / 60 AS lat, -(lon_deg + lon_min / 60) AS lon FROM catches
           WHERE species_code = 'TGT' AND (fishery <> 'longline' OR catch_count > 0))
"""


@query(
    "extent_and_occupancy",
    f"""
    WITH RECURSIVE {CAUGHT_SQL},
    seen AS (SELECT lat, lon, year, l_orderkey FROM surveys WHERE num_target > 0 UNION ALL SELECT lat, lon, year, NULL FROM caught),
    {spatial.INSIDE_SQL.replace('FROM surveys', 'FROM seen')},
    present AS (SELECT *, {X} AS x, {Y} AS y, CASE WHEN year <= 1997 THEN 'pre' WHEN year >= 1999 THEN 'post' END AS regime
                FROM seen s JOIN inside USING (lat, lon) WHERE NOT EXISTS ({LISTED_SQL})),
    {spatial.hull_sql('''SELECT DISTINCT regime, x, y FROM present WHERE regime IS NOT NULL
                         UNION ALL SELECT DISTINCT 'total', x, y FROM present''')},
    {spatial.ROWS_SQL},
    cell AS ({cell_sql('present', '[2000e0]')}),
    occ AS (SELECT regime, count(*) AS n_cells FROM (
              SELECT DISTINCT regime, ix, iy FROM cell WHERE regime IS NOT NULL
              UNION ALL SELECT DISTINCT 'total', ix, iy FROM cell) GROUP BY regime)
    SELECT h.regime, round(hull_km2, 3) AS hull_km2, round(hull_km2 - coalesce(km2, 0), 3) AS eoo_km2, n_cells, n_cells * 4e0 AS area_km2
    FROM hulls h LEFT JOIN masked m USING (regime)
    JOIN occ USING (regime)
    """,
    ("surveys", "catches"),
)
def extent_and_occupancy(spark, sf):
    """Extent and occupied area from the places where surveys saw the species and where fisheries caught it."""
    columns = ["lat", "lon", "year"]
    seen = views.surveys(spark, sf).where(F.col("num_target") > 0).select(*columns, "l_orderkey")
    caught = surveys.bycatch_presence(views.catches(spark, sf), "TGT", as_given=()).select(*columns)
    present = clean(spark, sf, combine.union_sources(seen, caught))
    rings, occupied = areas.extent_and_occupancy(present, views.GRID, 2000.0, ["pre", "post"])
    masked = spatial.masked_area(spark, rings, "regime").select(
        "regime", "hull_km2", F.col("area_km2").alias("eoo_km2")
    )
    out = masked.join(occupied.select("regime", "n_cells", "area_km2"), "regime")
    return round_all(out, "hull_km2", "eoo_km2", "area_km2", digits=3)


ROLLED_SQL = f"""
{CLEAN_SQL},
rolled AS (SELECT source, year, lat, lon, x, y, regime, median(num_target) AS median_count,
             max(CASE WHEN num_target > 0 THEN 1 ELSE 0 END) AS presence FROM cleaned GROUP BY ALL)
"""


def rolled(spark, sf):
    flagged = clean(spark, sf, views.surveys(spark, sf)).withColumn("presence", recode.presence("num_target"))
    return rollup.site_year_rollup(
        flagged, ["source", "year", "lat", "lon", "x", "y", "regime"], "num_target", "presence"
    )


@query(
    "median_change_summary",
    f"""
    WITH {ROLLED_SQL}, cell AS ({cell_sql('rolled')}),
    change AS (SELECT cell_size, ix, iy, median(median_count) FILTER (WHERE regime = 'pre') AS a,
                 median(median_count) FILTER (WHERE regime = 'post') AS b FROM cell GROUP BY ALL)
    SELECT cell_size, count(*) AS n_cells, count(*) FILTER (WHERE b > a) AS gains, count(*) FILTER (WHERE b < a) AS losses,
           count(*) FILTER (WHERE b = a) AS ties,
           round(avg(CASE WHEN b > a THEN 100 * (b - a) / b WHEN b < a THEN 100 * (b - a) / a ELSE 0 END), 6) AS mean_pct
    FROM change WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY cell_size
    """,
    ("surveys",),
)
def median_change_summary(spark, sf):
    cells = grid.assign_cells(rolled(spark, sf), views.GRID, views.CELL_SIZES)
    return round_all(areas.change_summary(cells, "median_count", "pre", "post"), "mean_pct")


@query(
    "presence_change_summary",
    f"""
    WITH {ROLLED_SQL},
    caught AS (SELECT year, lat_deg + lat_min / 60 AS lat, -(lon_deg + lon_min / 60) AS lon FROM catches
               WHERE species_code = 'TGT' AND (fishery <> 'longline' OR catch_count > 0)),
    both_sets AS (SELECT x, y, regime, presence FROM rolled
      UNION ALL SELECT {X} AS x, {Y} AS y, CASE WHEN year <= 1997 THEN 'pre' WHEN year >= 1999 THEN 'post' END, 1 FROM caught),
    cell AS ({cell_sql('both_sets')}),
    change AS (SELECT cell_size, ix, iy, max(presence) FILTER (WHERE regime = 'pre') AS a,
                 max(presence) FILTER (WHERE regime = 'post') AS b FROM cell GROUP BY ALL)
    SELECT cell_size, b - a AS change_presence, count(*) AS n_cells,
           CASE b - a WHEN -1 THEN 'loss of presence' WHEN 0 THEN 'no change' ELSE 'gain of presence' END AS label
    FROM change WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL
    """,
    ("surveys", "catches"),
)
def presence_change_summary(spark, sf):
    """Survey presence and the catch records of all four fisheries together, compared at both resolutions."""
    caught = surveys.bycatch_presence(views.catches(spark, sf), "TGT", as_given=())
    caught = grid.project(caught, views.CRS).withColumn("regime", recode.regime_of("year", AREA_REGIMES))
    columns = ["x", "y", "regime", "presence"]
    both = rolled(spark, sf).select(*columns).unionByName(caught.select(*columns))
    cells = grid.assign_cells(both, views.GRID, views.CELL_SIZES)
    return grid.presence_change_counts(grid.presence_change(cells, "pre", "post"))


@query(
    "index_with_effort",
    """
    WITH index AS (SELECT series, t, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.025) AS lower, quantile_cont(p, 0.975) AS upper
      FROM (SELECT 'state' AS series, t, 1 / (1 + exp(-x)) AS p FROM states
            UNION ALL SELECT 'observed', t, 1 / (1 + exp(-(x + dev_r * sd_r))) FROM states) GROUP BY series, t)
    SELECT year, series, round(median, 8) AS median, round(lower, 8) AS lower, round(upper, 8) AS upper,
           coalesce(n, 0) AS n_surveys, round(raw, 6) AS raw_presence
    FROM (SELECT series, t + 1994 AS year, median, lower, upper FROM index)
    LEFT JOIN (SELECT year, count(*) AS n, avg(CASE WHEN num_target > 0 THEN 1 ELSE 0 END) AS raw FROM surveys GROUP BY year) USING (year)
    """,
    ("states", "surveys"),
)
def index_with_effort(spark, sf):
    prob = lambda name: F.transform(name, lambda v: inv_logit(v))
    df = states(spark, sf)
    df = df.withColumn("observed", posterior.observed_path(F.col("x"), F.col("obs_dev"), F.col("sd_r")))
    long = posterior.long_by_position(df, ["draw"], {"state": prob("x"), "observed": prob("observed")})
    base = views.FIRST_YEAR - 1
    long = long.withColumn("year", F.col("t") + base)
    seen = views.surveys(spark, sf).select("year", recode.presence("num_target").alias("presence"))
    out = trends.index_with_effort(long, seen, base + 1, base + 22, ["state", "observed"])
    return round_all(round_all(out, "median", "lower", "upper", digits=8), "raw_presence")
