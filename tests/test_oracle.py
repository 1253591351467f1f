"""Every registered query against its SQL oracle, on whole tables."""

import pytest

import __spark_entry__ as entry
import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, sf, con, name):
    got, got_columns = oracle.spark_rows(entry.queries()[name](spark, sf))
    want, want_columns = oracle.duck_rows(con, entry.oracle_sql()[name])
    assert got_columns == want_columns
    assert got, "an empty result checks nothing"
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "year", "mean_presence", "n"]
    assert df.count() > 0


@pytest.mark.parametrize(
    "name",
    [
        "dedup_site_day", "distinct_keep_first", "dedup_two_level", "dense_ids", "per_group_row_number",
        "posterior_interval", "convex_hull_eoo", "occupancy_area", "ppc_sample", "two_file_survey_table",
    ],
)
def test_does_not_depend_on_partitioning(spark, sf, name):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    results = []
    try:
        for n in ("1", "7"):
            spark.conf.set(key, n)
            results.append(oracle.spark_rows(entry.queries()[name](spark, sf)))
    finally:
        spark.conf.set(key, before)
    assert results[0] == results[1]
