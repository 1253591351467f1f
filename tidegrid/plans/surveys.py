"""Cleaning chains: from raw survey files to harmonised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegrid.functions import recode
from tidegrid.functions.coords import degrees_minutes
from tidegrid.functions.dates import mixed_date_parts
from tidegrid.functions.missing import matches, paste
from tidegrid.operators import combine, dedup, lookup, rollup

DIVE = ["date_observed", "place", "observer"]
DIVE_COLUMNS = [
    "year", "month", "day", "stat_area", "sub_area", "num_quadrats", "num_count", "presence", "bottom_time", "lat", "lon",
    "depth", "source", "site",
]


def dive_table(flagged: DataFrame, counted: DataFrame, sheets: dict[str, DataFrame], tiebreak: list[str]) -> DataFrame:
    """Three dive programmes in one schema, DIVE_COLUMNS; what a programme does not record is NULL.

    ``flagged`` holds presence flags and ``counted`` holds counts; both keep one survey per
    place and day.  ``sheets`` are yearly files of one programme whose ids repeat between
    files, so the sheet letter becomes part of the id.
    """
    place_day = ["year", "month", "day", "lat", "lon"]
    first = dedup.keep_max(flagged.withColumn("source", F.lit("flagged")), place_day, "presence", tiebreak)
    known = counted.where(F.col("num_count").isNotNull()).withColumns(
        {"presence": recode.presence("num_count"), "source": F.lit("counted")}
    )
    second = dedup.keep_max(known, place_day, "presence", tiebreak)
    listed = combine.union_sources(
        *[df.withColumn("site", paste("site", F.lit(name))) for name, df in sheets.items()]
    )
    third = listed.where(F.col("num_count").isNotNull()).withColumns(
        {"presence": recode.presence("num_count"), "source": F.lit("index")}
    )
    out = combine.union_sources(third, first, second)
    return out.select(*[c if c in out.columns else F.lit(None).cast("double").alias(c) for c in DIVE_COLUMNS])


def small_sources(df: DataFrame, dropped: list[str], drop_pattern: str, tiebreak: list[str]) -> DataFrame:
    """Small programmes under one key: location and date, or location and year without a date."""
    kept = df.where(~F.col("source").isin(*dropped)).where(~matches("source", drop_pattern))
    keyed = kept.withColumns(
        {"location": paste("lat", "lon"), "date": F.coalesce("date", F.col("year").cast("string"))}
    )
    flagged = keyed.withColumns(
        {
            "after_start": recode.regime_of("year", [(0, None, 1997), (1, None, None)]),
            "during": recode.regime_of("year", [(1, 1998, 1999), (0, None, None)]),
            "site_ymd": paste("location", "date"),
        }
    )
    return dedup.keep_max(flagged, ["site_ymd"], "presence", tiebreak, count_as="n")


def species_facts(rows: DataFrame, target: str) -> DataFrame:
    """Distinct scores of the target species per dive and observer."""
    return (
        rows.where(F.col("species") == target)
        .select(*DIVE, recode.tag_to_score("tags").alias("score"))
        .distinct()
        .withColumn("seen", F.lit(1))
    )


def score_dives(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts joined back to every row of the dive; rows without a fact are absences."""
    joined = lookup.join_null_safe(rows, facts, DIVE, "left")
    joined = joined.withColumn("seen", F.coalesce("seen", F.lit(0)))
    return joined.withColumn("score_recode", recode.shift_score("seen", "score"))


def community_dives(rows: DataFrame, target: str, order: list[str]) -> DataFrame:
    """One row per dive: first row per observer, then the highest score among observers.

    Observers are reduced to one row, and facts to the first match of a dive (lowest score,
    unscored last), before they are joined: the join sees one row per dive and observer on
    both sides instead of one per species record.
    """
    per_observer = dedup.keep_first(rows, DIVE, order)
    facts = species_facts(rows, target).withColumn("unscored", F.col("score").isNull())
    first_fact = dedup.keep_first(facts, DIVE, ["unscored", "score"]).drop("unscored")
    usable = score_dives(per_observer, first_fact).dropna(subset=["score_recode", "max_depth"])
    usable = usable.withColumn("presence", F.when(F.col("score") > 0, 1).otherwise(0))
    return dedup.keep_max(usable, ["date_observed", "place"], "score_recode", order)


def fill_scores(scores: DataFrame, surveys: DataFrame, form: str = "formid") -> DataFrame:
    """Full join of scores and surveys, whole-row distinct, missing score read as zero."""
    joined = lookup.join_null_safe(scores, surveys, [("form", form)], "full").distinct()
    return joined.withColumn("abundance", F.coalesce("abundance", F.lit(0)))


def two_file_survey(scores: DataFrame, surveys: DataFrame, region: str) -> DataFrame:
    """Survey forms and scores from two files with mixed date formats, one row per site and day.

    Scores without a survey form have no site key; they all share the NULL key and so leave a
    single row, like any other group.
    """
    dated = surveys.where(matches("geogr", region)).withColumns(mixed_date_parts("date_text"))
    dated = dated.withColumn("site_ymd", paste("geogr", "day", "month", "year")).drop("date_text")
    seen = scores.where(matches("geozone", region)).select("form", "abundance")
    full = fill_scores(seen, dated)
    best = dedup.keep_max(full, ["site_ymd"], "abundance", ["form"])
    return best.withColumns(
        {
            "abundance_recode": F.col("abundance") + 1,
            "presence": recode.present_unless_zero("abundance"),
            "exp_binary": recode.binary_of("exp", "N", "E"),
            # an unknown year counts as inside the period
            "during": F.when((F.col("year") < 2014) | (F.col("year") > 2015), 0).otherwise(1),
            "region": F.substring("geogr", 1, 2),
        }
    )


def location_rollup(
    counted: DataFrame, scored: DataFrame, scored7: DataFrame, early: DataFrame, strict: DataFrame,
    sightings: DataFrame, uncounted: DataFrame,
) -> DataFrame:
    """Site-year rows of every source in one table; sources without counts have NULL counts."""
    keys = ["source", "year", "lat", "lon"]
    place = ["lat", "lon", "year"]
    seen_once = sightings.withColumns({"count": F.lit(1.0), "presence": F.lit(1)})
    parts = [
        rollup.site_year_rollup(counted, keys, "count", "presence"),
        rollup.site_year_rollup(scored, place, "count", "presence").withColumn("source", F.lit("scored")),
        rollup.site_year_rollup(scored7, place, "count", "presence").withColumn("source", F.lit("scored7")),
        early.where(F.col("presence") == 1).groupBy(*place).agg(
            F.count(F.lit(1)).alias("num_visits"), F.lit(1).alias("presence")
        ).withColumn("source", F.lit("early")),
        rollup.site_year_rollup(strict, keys, "count", "presence", strict_mean=True),
        rollup.site_year_rollup(seen_once, keys, "count", "presence"),
        rollup.site_year_rollup(uncounted, keys, None, "presence"),
    ]
    return combine.union_sources(*parts).distinct()


def bycatch_presence(catches: DataFrame, target: str, as_given: tuple[str, ...] = ("crab", "prawn")) -> DataFrame:
    """Presence-only records of four fisheries in one schema, from one scan.

    ``as_given`` names the fisheries whose longitude keeps its sign; that of the others is turned to west.
    Trap fisheries give depth in mixed units, the others metres.  Longline records need a positive catch.
    """
    trap = F.col("fishery").isin("crab", "prawn")
    kept = F.col("fishery").isin(*as_given) if as_given else F.lit(False)
    lon = degrees_minutes("lon_deg", "lon_min")
    rows = catches.where(
        (F.col("species_code") == target)
        & ((F.col("fishery") != "longline") | (F.col("catch_count") > 0))
    )
    return rows.select(
        "haul",
        F.concat("fishery", F.lit("_catch")).alias("source"),
        "year",
        degrees_minutes("lat_deg", "lat_min").alias("lat"),
        F.when(kept, lon).otherwise(-lon).alias("lon"),
        F.lit(1).alias("presence"),
        F.when(trap, recode.metres("max_depth", "depth_unit")).otherwise(F.col("max_depth")).alias("depth"),
    )


def catch_presence_absence(catches: DataFrame, target: str, fishery: str) -> DataFrame:
    """Presence or absence from catch counts of one fishery that records zeros."""
    rows = catches.where((F.col("species_code") == target) & (F.col("fishery") == fishery))
    return rows.select(
        "haul",
        F.concat("fishery", F.lit("_catch")).alias("source"),
        "year",
        degrees_minutes("lat_deg", "lat_min").alias("lat"),
        (-degrees_minutes("lon_deg", "lon_min")).alias("lon"),
        recode.present_unless_zero("catch_count").alias("presence"),
        F.col("max_depth").alias("depth"),
    )


PROGRAMME_COLUMNS = ["year", "presence", "site", "source", "source_group", "time", "area"]


def programmes(forms: DataFrame, community: DataFrame, small: DataFrame, dives: DataFrame) -> DataFrame:
    """The surveys of four programmes in one schema, PROGRAMME_COLUMNS.

    Small sources keep their own source beside the group they count as.  A dive's site is its statistical area,
    or its coordinates where it has none.
    """
    sited = dives.withColumns({"site": F.coalesce(F.col("stat_area").cast("string"), paste("lat", "lon")), "area": F.col("num_quadrats")})
    grouped = combine.union_sources(
        forms.select("year", "presence", F.col("geogr").alias("site"), F.lit("forms").alias("source"), F.col("btime").alias("time")),
        community.select(
            F.year("date_observed").alias("year"), "presence", F.col("place").cast("string").alias("site"),
            F.lit("community").alias("source"), F.col("max_depth").alias("time"),
        ),
        sited.select("year", "presence", "site", "source", F.col("area").cast("double").alias("area")),
    ).withColumn("source_group", F.col("source"))
    pooled = small.select("year", "presence", F.col("location").alias("site"), "source", F.lit("small").alias("source_group"), F.col("bottom_time").alias("time"), "area")
    return combine.union_sources(grouped, pooled).select(*PROGRAMME_COLUMNS)
