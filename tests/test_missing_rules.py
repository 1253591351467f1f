"""One small frame per missing-value and tie rule."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import missing, recode
from tidegrid.functions.dates import mixed_date_parts
from tidegrid.operators import combine, dedup, encode, lookup, ranks, rollup
from tidegrid.plans import surveys
from tidegrid.sources import tables


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_keep_max_ties_and_missing(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2), ("a", 3.0, 5), ("a", 3.0, 4), ("b", None, 7), ("b", None, 6), ("c", None, 1),
         ("c", 0.0, 2), (None, 1.0, 1), (None, 2.0, 2)],
        "k string, v double, id int",
    )
    out = dedup.keep_max(df, ["k"], "v", ["id"])
    assert rows(out, "k", "v", "id", "num_surveys", "multiple_surveys") == sorted(
        [("a", 3.0, 4, 3, 1), ("b", None, 6, 2, 1), ("c", 0.0, 2, 2, 1), (None, 2.0, 2, 2, 1)], key=repr
    )
    again = dedup.keep_max(out.drop("num_surveys", "multiple_surveys"), ["k"], "v", ["id"])
    assert rows(again, "k", "v", "id") == rows(out, "k", "v", "id")


def test_keep_first_keeps_all_columns(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, t string")
    assert rows(dedup.keep_first(df, ["k"], ["o"]), "k", "o", "t") == [("a", 1, "y"), ("b", 3, None)]


def test_paste_spells_missing(spark):
    df = spark.createDataFrame([(1.5, None), (None, "x")], "a double, b string")
    assert rows(df.select(missing.paste("a", "b").alias("k"))) == [("1.5_NA",), ("NA_x",)]


def test_joins_match_missing_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, l int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, r int")
    joined = lookup.join_null_safe(left, right, ["k"], "left")
    assert rows(joined, "k", "l", "r") == sorted([(None, 1, 10), ("a", 2, 20), ("b", 3, None)], key=repr)
    anti = lookup.exclude(left, right, ["k"])
    assert rows(anti, "k", "l") == [("b", 3)]


def test_full_join_keeps_one_key_and_unmatched_rows_share_the_null_group(spark):
    scores = spark.createDataFrame([(1, 2), (8, 3), (9, 4)], "form int, abundance int")
    forms = spark.createDataFrame([(1, "s1"), (2, "s2")], "formid int, site_ymd string")
    full = surveys.fill_scores(scores, forms)
    assert rows(full, "form", "abundance", "site_ymd") == sorted(
        [(1, 2, "s1"), (2, 0, "s2"), (8, 3, None), (9, 4, None)], key=repr
    )
    best = dedup.keep_max(full, ["site_ymd"], "abundance", ["form"])
    assert rows(best, "form", "num_surveys") == [(1, 1), (2, 1), (9, 2)]


def test_strict_and_lenient_aggregates(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "k string, v double"
    )
    out = df.groupBy("k").agg(
        missing.strict_avg("v").alias("m"), missing.strict_max("v").alias("x"), F.avg("v").alias("a")
    )
    assert rows(out) == [("a", None, None, 1.0), ("b", 3.0, 4.0, 3.0), ("c", None, None, None)]


def test_nan_is_mapped_out(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert one(df.agg(F.avg(missing.nan_to_null("v")).alias("v")), F.col("v")) == 1.0


def test_text_to_number_and_negated_patterns(spark):
    df = spark.createDataFrame([("few",), ("7",), ("?",), (None,)], "t string")
    assert [r[0] for r in df.select(missing.as_number("t")).collect()] == [None, 7.0, None, None]
    assert [r[0] for r in df.select(~missing.matches("t", "^f")).collect()] == [False, True, True, True]
    assert [r[0] for r in df.select(missing.sentinel_to_null("t", "?")).collect()] == ["few", "7", None, None]


@pytest.mark.parametrize(
    "tag,score",
    [("none", 0), ("few", 1), ("5+", 1), ("0", 1), ("10", 1), ("11", 2), ("25", 2), ("26", 3), ("51", 4),
     ("100", 4), ("101", 5), ("1000", 5), ("1001", 6), ("very many", 4), ("?", None), (None, None)],
)
def test_tags(spark, tag, score):
    df = spark.createDataFrame([(tag,)], "t string")
    assert one(df, recode.tag_to_score("t")) == score


def test_shifted_scores_and_flags(spark):
    df = spark.createDataFrame([(0, None), (1, None), (1, 3)], "seen int, score int")
    assert [r[0] for r in df.select(recode.shift_score("seen", "score")).collect()] == [1, None, 4]
    flags = spark.createDataFrame([(0,), (None,), (2,)], "v int")
    assert [r[0] for r in flags.select(recode.presence("v")).collect()] == [0, 0, 1]
    assert [r[0] for r in flags.select(recode.present_unless_zero("v")).collect()] == [0, 1, 1]


def test_score_counts(spark):
    df = spark.createDataFrame([(i,) for i in range(8)], "s int")
    five = [r[0] for r in df.select(recode.score_to_count("s", recode.FIVE_LEVEL_COUNTS)).collect()]
    seven = [r[0] for r in df.select(recode.score_to_count("s", recode.SEVEN_LEVEL_COUNTS, 1)).collect()]
    assert five == [0, 1, 2, 11, 101, None, None, None]
    assert seven == [None, 0, 1, 11, 26, 51, 101, 1001]


def test_regimes_may_overlap_or_leave_gaps(spark):
    df = spark.createDataFrame([(2012,), (2013,), (2015,), (None,)], "y int")
    label = recode.regime_of("y", [("pre", None, 2012), ("post", 2015, None)])
    assert [r[0] for r in df.select(label).collect()] == ["pre", None, "post", None]


def test_mixed_dates(spark):
    df = spark.createDataFrame([("7/4/07",), ("2019-11-02",), ("no date",), (None,)], "d string")
    got = rows(df.select(*[c.alias(n) for n, c in mixed_date_parts("d").items()]))
    assert got == sorted([(2007, 7, 4), (2019, 11, 2), (None, None, None), (None, None, None)], key=repr)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (6.0, 5.0)], "x double, c double")
    out = encode.zscore_pooled(df, {"z": "x", "const": "c"})
    z = [r["z"] for r in out.orderBy("x").collect()]
    assert z[0] is None
    mean, sd = 3.0, math.sqrt(7.0)
    assert z[1:] == pytest.approx([(v - mean) / sd for v in (1.0, 2.0, 6.0)])
    assert {r["const"] for r in out.collect()} == {None}


def test_scaling_precedes_the_effort_filter(spark):
    df = spark.createDataFrame(
        [(10.0, None), (20.0, None), (60.0, 4.0), (None, 8.0), (None, None)], "time double, area double"
    )
    out = encode.effort_design(df)
    got = {(r["time"], r["area"]): r for r in out.collect()}
    assert len(got) == 4
    sd = math.sqrt(((20**2) + (10**2) + (30**2)) / 2)
    assert got[(10.0, None)]["scaled_effort"] == pytest.approx(-20 / sd)
    assert got[(60.0, 4.0)]["effort_type"] == 0
    assert got[(60.0, 4.0)]["time_term"] == pytest.approx(30 / sd)
    assert got[(None, 8.0)]["time_term"] == 0.0


def test_scaling_by_dataset(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)], "k string, x double")
    half = 1 / math.sqrt(2)
    got = {(r["k"], r["x"]): r["z"] for r in encode.zscore_by(df, "k", {"z": "x"}).collect()}
    assert got == {("a", 1.0): pytest.approx(-half), ("a", 3.0): pytest.approx(half), (None, 5.0): pytest.approx(-half), (None, 9.0): pytest.approx(half)}


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2, 3.0)], "a int, c double")
    assert rows(combine.union_sources(a, b)) == [(1, "x", None), (2, None, 3.0)]


def test_column_ranges(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert combine.drop_range(df, "b", "c").columns == ["a", "d"]
    assert combine.keep_range(df, "b", "d").columns == ["b", "c", "d"]


def test_headers():
    raw = ["RowID", "PlotCount", "Mean. height", "day", "Day", "TotalOf3AB", "XValue", "Z_code", "name.y", "% shade", "4th"]
    assert tables.clean_names(raw) == [
        "row_id", "plot_count", "mean_height", "day", "day_2", "total_of3ab", "x_value", "z_code", "name_y",
        "percent_shade", "x4th",
    ]


def test_csv_with_headers_that_differ_in_case_and_bad_text(spark, tmp_path):
    (tmp_path / "f.csv").write_text("date,Date,Depth\n1-Jul-11,x,?\n,y,4.5\n")
    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField("date", T.StringType()), T.StructField("date_2", T.StringType()),
         T.StructField("depth", T.DoubleType())]
    )
    assert rows(tables.read_csv(spark, str(tmp_path / "f.csv"), schema)) == sorted(
        [("1-Jul-11", "x", None), (None, "y", 4.5)], key=repr
    )


def test_cardinality_counts_missing_as_a_value(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "v int")
    assert rows(rollup.cardinalities(df, {"n_v": "v"})) == [(3, 2)]


def test_isolated_years(spark):
    df = spark.createDataFrame([("a", y) for y in (2017, 2018, 2019, 2021)], "k string, year int")
    out = {r["year"]: r["isolated"] for r in encode.isolated_years(df, ["k"]).collect()}
    assert out == {2017: 0, 2018: 0, 2019: 0, 2021: 1}


def test_regime_by_year_fills_the_span(spark):
    df = spark.createDataFrame([(2000,), (2002,)], "year int")
    out = encode.regime_by_year(df, [(0, None, 2000), (1, 2001, 2001), (2, 2002, None)], 1999, 2003)
    assert rows(out, "year", "regime", "surveyed") == [
        (1999, 0, 0), (2000, 0, 1), (2001, 1, 0), (2002, 2, 1), (2003, 2, 0)
    ]


def test_community_dives_take_the_highest_observer(spark):
    day = datetime.date(2020, 5, 1)
    df = spark.createDataFrame(
        [
            (1, day, 1, 1, "other", None, 9.0), (2, day, 1, 1, "target", "few", 9.0),
            (3, day, 1, 2, "target", "many", 9.0), (4, day, 2, 1, "other", "few", 9.0),
            (5, day, 3, 1, "target", "?", 9.0), (6, day, 4, 1, "target", "few", None),
        ],
        "row_id int, date_observed date, place int, observer int, species string, tags string, max_depth double",
    )
    out = surveys.community_dives(df, "target", ["row_id"])
    assert rows(out, "place", "row_id", "score_recode", "presence", "num_surveys") == [
        (1, 3, 4, 1, 2), (2, 4, 1, 0, 1)
    ]
