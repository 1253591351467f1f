"""Ranks, quantiles and ids against brute force, with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import checks, ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    parts = [
        pd.DataFrame({"k": "hot", "v": np.round(rng.normal(0, 50, 4000), 2)}),
        pd.DataFrame({"k": "same", "v": np.full(500, 3.25)}),
        pd.DataFrame({"k": "wide", "v": 10.0 ** rng.uniform(-9, 9, 700) * rng.choice([-1, 1], 700)}),
        pd.DataFrame({"k": "one", "v": [0.5]}),
        pd.DataFrame({"k": None, "v": [1.0, 2.0, np.nan]}),
        pd.DataFrame({"k": "empty", "v": [np.nan]}),
    ]
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(
        [(None if pd.isna(k) else k, None if pd.isna(v) else float(v)) for k, v in pdf.itertuples(index=False)],
        "k string, v double",
    )
    return pdf, df.repartition(6)


def test_exact_quantiles(skewed):
    pdf, df = skewed
    probs = {"lo": 0.025, "mid": 0.5, "hi": 0.975, "min": 0.0, "max": 1.0}
    got = {r["k"]: r for r in ranks.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert "empty" not in got
    for key, part in pdf.dropna(subset=["v"]).groupby("k", dropna=False):
        key = None if pd.isna(key) else key
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(part["v"], p), rel=1e-12, abs=1e-15)


def test_quantiles_without_keys(skewed):
    pdf, df = skewed
    row = ranks.exact_quantiles(df, [], "v", {"mid": 0.5}).collect()
    assert row[0]["mid"] == pytest.approx(pdf["v"].median())


def test_cumulative_counts(skewed):
    pdf, df = skewed
    got = {(r["k"], r["v"]): (r["n"], r["cum"], r["total"]) for r in ranks.cumulative_counts(df, ["k"], "v").collect()}
    for key, part in pdf.dropna(subset=["v"]).groupby("k", dropna=False):
        key = None if pd.isna(key) else key
        for v, n in part["v"].value_counts().items():
            assert got[(key, v)] == (n, (part["v"] <= v).sum(), len(part))


def test_numbers_rise_with_values(spark):
    values = sorted([float("-inf"), -1e300, -5.0, -1e-7, -5e-324, -0.0, 0.0, 5e-324, 1e-9, 1e-6, 0.5, 0.5000001, 3.0, 1e5, 1e300, float("inf")])
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double")
    got = [r["b"] for r in df.select("v", ranks.ordered(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) == len(values)


NARROW = {
    "uniform": lambda rng, n: 1e6 + 1e3 * rng.random(n),
    "very narrow": lambda rng, n: 1.0 + 1e-6 * rng.random(n),
    "two clusters": lambda rng, n: np.where(rng.random(n) < 0.5, 5.0 + 1e-5 * rng.random(n), 1e3 * rng.random(n)),
    "one outlier": lambda rng, n: np.concatenate([[1e300], rng.random(n - 1) * 1e-3 - 7.0]),
}


@pytest.mark.parametrize("name", NARROW)
def test_no_task_sorts_more_than_a_small_share(spark, name):
    values = NARROW[name](np.random.default_rng(1), 200_000)
    df = spark.createDataFrame(pd.DataFrame({"k": "all", "v": values}))
    probs = [0.025, 0.5, 0.975]
    wanted = ranks._wanted(ranks._first_digits(df, ["k"], "v"), ["k"], probs)
    for _ in range(ranks.PASSES):
        wanted = ranks._wanted(ranks._next_digits(ranks._inside(df, wanted, ["k"], "v"), ["k"]), ["k"], probs)
    sorted_together = ranks._inside(df, wanted, ["k"], "v").groupBy("s.lo").count().agg(F.max("count")).first()[0]
    assert sorted_together <= 0.01 * len(values)
    got = ranks.exact_quantiles(df, ["k"], "v", {str(p): p for p in probs}).first()
    for p in probs:
        assert got[str(p)] == pytest.approx(np.quantile(values, p), rel=1e-14)


def test_cumulative_counts_of_narrow_values_in_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(ranks, "STRETCH", 500)
    values = np.round(1e6 + 1e3 * np.random.default_rng(2).random(20_000), 1)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = ranks.cumulative_counts(df, [], "v").toPandas().sort_values("v")
    unique, n = np.unique(values, return_counts=True)
    assert got["v"].tolist() == unique.tolist() and got["n"].tolist() == n.tolist() and got["cum"].tolist() == np.cumsum(n).tolist()


def test_dense_ids(spark):
    values = [f"site-{i * 7919 % 3001}" for i in range(3001)] + ["Zed", "alpha", "é"]
    df = spark.createDataFrame([(v,) for v in values] * 2 + [(None,)], "s string")
    out = ranks.with_dense_id(df, "s", "id")
    assert out.count() == len(values) * 2 + 1
    got = {r["s"]: r["id"] for r in out.distinct().collect()}
    expect = {v: i + 1 for i, v in enumerate(sorted(set(values), key=lambda s: s.encode()))}
    assert got == {**expect, None: None}


def test_dense_ids_in_spark_order_with_nan_last(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, float("nan"), 2.0, 0.5)], "v double")
    got = {str(r["v"]): r["id"] for r in ranks.with_dense_id(df, "v", "id").collect()}
    assert got == {"0.5": 1, "1.0": 2, "2.0": 3, "3.0": 4, "nan": 5}


def test_dense_ids_of_each_dataset(spark):
    rows = [(d, f"s{(i * k) % 97}") for d, k in (("a", 3), ("b", 5), (None, 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "d string, s string")
    got = {(r["d"], r["s"]): r["id"] for r in ranks.with_dense_id(df, "s", "id", keys=["d"]).collect()}
    for d in ("a", "b", None):
        names = sorted({s for e, s in rows if e == d})
        assert {s: i for (e, s), i in got.items() if e == d} == {s: i + 1 for i, s in enumerate(names)}


def test_numbered_within(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.7, 0, rng.integers(1, 9, 3000)),
                        "day": rng.integers(0, 40, 3000), "id": rng.permutation(3000)})
    out = ranks.numbered_within(spark.createDataFrame(pdf), ["k"], "day", ["id"]).toPandas()
    expect = pdf.sort_values(["k", "day", "id"])
    expect["row"] = expect.groupby("k").cumcount() + 1
    merged = out.merge(expect, on=["k", "day", "id"], suffixes=("", "_x"))
    assert len(merged) == 3000 and (merged["row"] == merged["row_x"]).all()


def test_histogram_top_edge(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    got = {r["bin"]: r["n"] for r in ranks.histogram(df, [], "v", 5, F.lit(0.0), F.lit(10.0)).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_ks_distance(spark):
    rng = np.random.default_rng(11)
    u = np.sort(np.concatenate([rng.random(500) ** 1.3, np.full(40, 0.25)]))
    df = spark.createDataFrame([(float(v),) for v in u], "u double")
    n = len(u)
    expect = max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max())
    assert checks.ks_uniform(df, [], "u").first()["ks"] == pytest.approx(expect)


def test_array_median(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([4, 1],), ([7],)], "a array<int>")
    assert [r[0] for r in df.select(checks.array_median(F.col("a"))).collect()] == [2.0, 2.5, 7.0]


@pytest.mark.parametrize("name", ["clusters", "flat", "outside"])
def test_ks_distance_of_weighted_groups(spark, name):
    """The greatest distance over all values, whatever parts of [0, 1] it may lie in."""
    rng = np.random.default_rng(8)
    own = {
        "clusters": np.where(rng.random(4000) < 0.5, 0.3 + 1e-6 * rng.random(4000), rng.random(4000)),
        "flat": (np.arange(4000) + 0.5) / 4000,
        "outside": np.concatenate([rng.normal(size=3990), np.full(10, 7.0)]),
    }[name]
    pdf = pd.DataFrame({"k": np.where(np.arange(4000) % 3 == 0, "a", None), "v": own, "w": rng.integers(1, 4, 4000)})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("a", None, 5)], "k string, v double, w long"))
    got = {r["k"]: (r["ks"], r["n"]) for r in checks.ks_uniform(df, ["k"], "v", "w").collect()}
    assert len(got) == 2
    for key, part in pdf.groupby(pdf["k"].notna()):
        v, w = np.unique(part["v"], return_inverse=True)
        n = np.bincount(w, part["w"])
        cum, total = np.cumsum(n), n.sum()
        assert got["a" if key else None] == (np.maximum(cum / total - v, v - (cum - n) / total).max(), total)
