"""Draw tables, likelihoods, checks and fits against plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import links
from tidegrid.functions.recode import FIVE_LEVEL_COUNTS, SEVEN_LEVEL_COUNTS
from tidegrid.operators import checks, fit, posterior


def logistic(x):
    return 1 / (1 + math.exp(-x))


def values(spark, frame, **columns):
    df = spark.createDataFrame(frame)
    return df.select(*[c.alias(n) for n, c in columns.items()]).collect()


def test_state_path(spark):
    rng = np.random.default_rng(1)
    dev = rng.normal(size=6)
    df = spark.createDataFrame([(0.5, dev.tolist(), 0.3, -0.1, -1.0, 0.2)], "x0 double, dev array<double>, sd double, a double, b double, c double")
    drift = {0: F.col("a"), 1: F.col("b"), 2: F.col("c")}
    for codes in ([2, 0, 0, 1, 2, 2], [0, 0, 1, 1, 0, 0]):
        got = df.select(posterior.state_path(F.col("x0"), F.col("dev"), F.col("sd"), drift, codes, 0)).first()[0]
        x, expect = 0.5, []
        for t, code in enumerate(codes):
            x += {0: -0.1, 1: -1.0, 2: 0.2}[0 if t == 0 else code] + dev[t] * 0.3
            expect.append(x)
        assert got == pytest.approx(expect)


@pytest.mark.parametrize("weights", [FIVE_LEVEL_COUNTS, SEVEN_LEVEL_COUNTS])
def test_ordinal_scale(spark, weights):
    k = len(weights)
    cuts = np.cumsum(np.r_[-1.0, np.full(k - 2, 0.7)]).tolist()
    df = spark.createDataFrame([(x, cuts) for x in (-3.0, 0.2, 4.0)], "x double, cuts array<double>")
    probs = links.ordinal_probabilities(F.col("x"), F.col("cuts"), k)
    for row in df.select("x", F.array(*probs).alias("p"), links.ordinal_expected(F.col("x"), F.col("cuts"), weights).alias("n")).collect():
        cdf = [logistic(c - row["x"]) for c in cuts] + [1.0]
        expect = np.diff([0.0] + cdf)
        assert row["p"] == pytest.approx(expect.tolist())
        assert sum(row["p"]) == pytest.approx(1.0)
        assert row["n"] == pytest.approx(float(expect @ np.array(weights)))


def test_ordinal_likelihood_matches_probabilities(spark):
    cuts = [-1.0, 0.0, 1.5, 2.0]
    df = spark.createDataFrame([(lv, x, cuts) for lv in range(1, 6) for x in (-2.0, 0.3, 5.0)], "y int, x double, cuts array<double>")
    for r in df.select("y", "x", links.loglik_ordinal(F.col("y"), F.col("x"), F.col("cuts"), 5).alias("ll")).collect():
        cdf = [0.0] + [logistic(c - r["x"]) for c in cuts] + [1.0]
        assert r["ll"] == pytest.approx(math.log(cdf[r["y"]] - cdf[r["y"] - 1]), rel=1e-9)


def test_log_gamma(spark):
    zs = [1e-3, 0.1, 0.5, 1.0, 2.0, 3.7, 12.0, 150.5, 1e6]
    got = values(spark, pd.DataFrame({"z": zs}), v=links.log_gamma("z"))
    assert [r["v"] for r in got] == pytest.approx([math.lgamma(z) for z in zs], rel=1e-11, abs=1e-11)


def nb_logpmf(y, eta, phi):
    mu = math.exp(eta)
    return (math.lgamma(y + phi) - math.lgamma(phi) - math.lgamma(y + 1)
            + y * math.log(mu / (mu + phi)) + phi * math.log(phi / (mu + phi)))


def test_count_likelihoods(spark):
    frame = pd.DataFrame([(y, e, p, t) for y in (0.0, 1.0, 7.0) for e in (-2.0, 1.3) for p in (0.4, 9.0) for t in (-1.0, 2.0)],
                         columns=["y", "e", "p", "t"])
    df = spark.createDataFrame(frame).withColumn("nb", links.loglik_negbin(F.col("y"), F.col("e"), F.col("p")))
    for r in df.withColumn("zi", links.loglik_zinb(F.col("y"), F.col("nb"), F.col("t"))).collect():
        nb = nb_logpmf(r["y"], r["e"], r["p"])
        w = logistic(r["t"])
        assert r["nb"] == pytest.approx(nb)
        expect = math.log(w + (1 - w) * math.exp(nb)) if r["y"] == 0 else math.log(1 - w) + nb
        assert r["zi"] == pytest.approx(expect)


def test_bernoulli_likelihood_is_stable(spark):
    got = values(spark, pd.DataFrame({"y": [1, 0, 1], "e": [0.3, 0.3, -800.0]}), v=links.loglik_bernoulli(F.col("y"), F.col("e")))
    assert [r["v"] for r in got] == pytest.approx([math.log(logistic(0.3)), math.log(1 - logistic(0.3)), -800.0])


def test_cutpoint_prior_jacobian(spark):
    for cuts in ([-1.0, 0.4], [-2.0, -0.5, 0.1, 1.3], [-2.0, -1.0, 0.0, 0.5, 1.0, 3.0]):
        k = len(cuts) + 1
        s = [logistic(-c) for c in cuts]
        jac = np.zeros((k, k))
        jac[:, 0] = 1
        for i in range(1, k):
            rho = s[i - 1] * (1 - s[i - 1])
            jac[i, i], jac[i - 1, i] = -rho, rho
        expect = math.lgamma(k) + np.linalg.slogdet(jac)[1]
        df = spark.createDataFrame([(cuts,)], "c array<double>")
        assert df.select(links.logpdf_induced_dirichlet(F.col("c"), k)).first()[0] == pytest.approx(expect)


def test_prior_densities(spark):
    got = values(spark, pd.DataFrame({"x": [0.7]}), n=links.logpdf_normal(F.col("x"), 0, 5),
                 g=links.logpdf_gamma(F.col("x"), 2, 4), i=links.logpdf_inv_gamma(F.col("x"), 5, 5))[0]
    x = 0.7
    assert got["n"] == pytest.approx(-0.5 * (x / 5) ** 2 - math.log(5 * math.sqrt(2 * math.pi)))
    assert got["g"] == pytest.approx(2 * math.log(4) + math.log(x) - 4 * x)
    assert got["i"] == pytest.approx(5 * math.log(5) - math.lgamma(5) - 6 * math.log(x) - 5 / x)


def test_sample_is_reproducible_and_without_repeats(spark):
    df = spark.range(500).withColumnRenamed("id", "draw")
    a = [r["draw"] for r in posterior.sample_draws(df, 50, 1).collect()]
    b = [r["draw"] for r in posterior.sample_draws(df.repartition(9), 50, 1).collect()]
    c = [r["draw"] for r in posterior.sample_draws(df, 50, 2).collect()]
    assert sorted(a) == sorted(b) and len(set(a)) == 50 and set(a) != set(c)


def test_effects_walk_equals_direct_sum(spark):
    rng = np.random.default_rng(4)
    draws = [(i, rng.normal(size=3).tolist(), float(rng.normal())) for i in range(20)]
    draws = [(i * 100, a, s) for i, a, s in draws]  # over several blocks
    table = spark.createDataFrame(draws, "draw long, a array<double>, s double")
    obs = spark.createDataFrame([(o, o % 3 + 1) for o in range(30)], "obs long, idx int")
    effects = posterior.DrawEffects(table, {"a": "idx"}, ["s"])
    rows = effects.per_draw(posterior.spread(obs, "obs"))
    got = {(r["obs"], r["draw"]): r["v"] for r in rows.select("obs", F.col("p.draw").alias("draw"), (F.col("a") + F.col("p.s")).alias("v")).collect()}
    assert len(got) == 600
    for d, a, s in draws:
        for o in range(30):
            assert got[(o, d)] == pytest.approx(a[o % 3] + s)


def test_an_unknown_id_does_not_vanish(spark):
    table = spark.createDataFrame([(1, [0.5, 0.7], [1.0, 2.0], 0.1)], "draw long, a array<double>, b array<double>, s double")
    effects = posterior.DrawEffects(table, {"a": "i", "b": "j"}, ["s"])
    for i, j in ((1, 5), (7, 1), (None, 1), (2, None)):
        obs = spark.createDataFrame([(i, j), (1, 1)], "i int, j int")
        with pytest.raises(Exception, match="no effect"):
            effects.per_draw(obs).agg(F.sum("a"), F.sum("b")).collect()


def test_observed_path_of_sampled_years(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [10.0, 20.0], [2, 4])], "x array<double>, dev array<double>, at array<int>")
    path = lambda **k: df.select(posterior.observed_path(F.col("x"), F.col("dev"), F.lit(1.0), **k)).first()[0]
    assert path(index=F.col("at")) == [12.0, 24.0]
    assert path(index=F.col("at"), offset=F.lit(0.5)) == [12.5, 24.5]
    with pytest.raises(Exception, match="every year"):
        path()


def test_negative_binomial_draws(spark):
    us = np.r_[np.linspace(0.0005, 0.9995, 200), 0.0, 1 - 2**-32]
    frame = pd.DataFrame([(u, m, p) for u in us for m, p in ((0.02, 0.3), (4.0, 1.2), (90.0, 8.0))], columns=["u", "m", "p"])
    df = checks.with_negbin_draw(spark.createDataFrame(frame), "u", "m", "p", "k")
    for r in df.collect():
        cdf, k = 0.0, -1
        while cdf < r["u"] or k < 0:
            k += 1
            cdf += math.exp(nb_logpmf(k, math.log(r["m"]), r["p"]))
            if k > 3000:
                break
        assert abs(r["k"] - k) <= (0 if r["u"] < 0.9999 else 30), (r, k)


def test_split_rhat(spark):
    rng = np.random.default_rng(8)
    chains = rng.normal(size=(4, 25)) + np.array([[0], [0], [0], [0.8]])
    df = spark.createDataFrame([(1, c, i, float(v)) for c, row in enumerate(chains) for i, v in enumerate(row)],
                               "param int, chain int, iteration long, value double")
    halves = np.concatenate([chains[:, :12], chains[:, 13:]])
    within, between = halves.var(axis=1, ddof=1).mean(), 12 * halves.mean(axis=1).var(ddof=1)
    got = checks.split_rhat(df, "param", "value").first()["rhat"]
    assert got == pytest.approx(math.sqrt((between / within + 11) / 12))
    assert checks.flag_unconverged(checks.split_rhat(df, "param", "value")).count() == 1


def test_quantile_residuals_split_ties(spark):
    df = spark.createDataFrame([(1, [0, 0, 1, 1, 2], 0.5), (3, [0, 1], 0.9), (-1, [0, 1], 0.9)], "y int, s array<int>, u double")
    got = [r[0] for r in df.select(checks.quantile_residual(F.col("y"), F.col("s"), F.col("u"))).collect()]
    assert got == pytest.approx([0.4 + 0.5 * 0.4, 1.0, 0.0])


# --- fits ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(17)
    n = 4000
    pdf = pd.DataFrame({"year_id": rng.integers(1, 5, n), "site_id": rng.integers(1, 4, n), "x": np.round(rng.normal(size=n), 1)})
    eta = -0.5 + 0.4 * pdf["year_id"] - 0.3 * pdf["site_id"] + 0.5 * pdf["x"]
    pdf["presence"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    pdf["y"] = rng.poisson(np.exp(eta)).astype(float)
    return pdf, spark.createDataFrame(pdf)


def dense_fit(x, y, penalty, mean):
    beta = np.zeros(x.shape[1])
    for _ in range(80):
        mu, w = mean(np.clip(x @ beta, -30, 30))
        beta += np.linalg.solve(x.T @ (x * w[:, None]) + np.diag(penalty), x.T @ (y - mu) - penalty * beta)
    return beta


MEANS = {"logistic": lambda e: (1 / (1 + np.exp(-e)), np.exp(e) / (1 + np.exp(e)) ** 2), "poisson": lambda e: (np.exp(e), np.exp(e))}


@pytest.mark.parametrize("family, y", [("logistic", "presence"), ("poisson", "y")])
def test_fit_is_the_penalised_optimum(design, family, y):
    pdf, df = design
    found = fit.fit_mixed(df, {"year_id": 4}, ["x"], "site_id", y, family, sd=1.5, site_sd=0.7)
    x = np.concatenate([np.eye(4)[pdf["year_id"] - 1], pdf[["x"]].to_numpy(), np.eye(3)[pdf["site_id"] - 1]], axis=1)
    beta = dense_fit(x, pdf[y].to_numpy(), np.r_[np.full(5, 1 / 1.5**2), np.full(3, 1 / 0.7**2)], MEANS[family])
    assert found.last_step < 1e-9
    assert found.values.tolist() == pytest.approx(beta[:5].tolist(), abs=1e-7)
    assert [r["effect"] for r in found.sites.orderBy("site").collect()] == pytest.approx(beta[5:].tolist(), abs=1e-7)
    rows = fit.fitted_means(df, found, "site_id", family, ["year_id"], ["x"])
    mu = MEANS[family](x @ beta)[0]
    assert rows.agg(F.sum("fitted")).first()[0] == pytest.approx(mu.sum())
    if family == "poisson":
        phi = rows.agg(fit.dispersion(rows, "y", "fitted").alias("phi")).first()[0]
        assert phi == pytest.approx((mu**2).sum() / ((pdf["y"] - mu) ** 2 - mu).sum(), rel=1e-5)


def test_fit_of_ten_thousand_sites(spark):
    """The score equations hold for every year and every site."""
    rng = np.random.default_rng(5)
    n = 60_000
    pdf = pd.DataFrame({"site": rng.integers(1, 10_001, n), "year_id": rng.integers(1, 5, n), "x": np.round(rng.normal(size=n), 1)})
    effect = rng.normal(size=10_001)
    pdf["y"] = rng.poisson(np.exp(-0.5 + 0.2 * pdf["year_id"] + effect[pdf["site"]])).astype(float)
    pdf.loc[: n // 3, "site"] = 17  # a hot site
    df = spark.createDataFrame(pdf)
    found = fit.fit_mixed(df, {"year_id": 4}, ["x"], "site", "y", "poisson", sd=2.0, site_sd=1.0)
    sites = found.sites.toPandas().set_index("site")["effect"]
    assert len(sites) == pdf["site"].nunique()
    mu = np.exp(found.values[pdf["year_id"] - 1] + found.values[4] * pdf["x"] + sites[pdf["site"]].to_numpy())
    gap = pdf["y"] - mu
    assert np.abs(gap.groupby(pdf["year_id"]).sum() - found.values[:4] / 4).max() < 1e-5
    assert np.abs(gap.groupby(pdf["site"]).sum() - sites).max() < 1e-5


def test_ordinal_fit_orders_its_cutpoints(design):
    pdf, df = design
    three = df.withColumn("level", F.least(F.col("y"), F.lit(3.0)).cast("int") + 1)
    rows = fit.with_thresholds(three, "level", 4)
    coef = fit.fit_mixed(rows, {"cut": 3, "year_id": 4}, ["x"], "site_id", "above", "logistic", sd=3.0, site_sd=3.0).coefficients()
    cuts = [-r["coefficient"] for r in coef.where("term = 'cut'").orderBy("id").collect()]
    assert len(cuts) == 3 and cuts == sorted(cuts)
    index = {r["id"]: r["expected"] for r in fit.expected_from_cuts(coef, "year_id", [0, 1, 2, 3]).collect()}
    raw = three.groupBy("year_id").agg(F.avg(F.col("level") - 1).alias("m")).toPandas().set_index("year_id")["m"]
    assert sorted(index, key=index.get) == raw.sort_values().index.tolist()


def test_local_level_filter(spark):
    df = spark.createDataFrame(
        [("a", 2000, 1.0), ("a", 2000, 2.0), ("a", 2001, 0.5), ("a", 2003, 0.2), ("b", 2002, 4.0)], "s string, year int, v double"
    )
    series = fit.annual_series(df, "s", "year", F.col("v"), 2000, 2003)
    run = lambda y, q, r: fit.local_level_filter(y, q, r, {0: 0.1, 1: -0.5}, [(0, None, 2001), (1, 2002, None)], 2000)
    got = {r["s"]: r["f"] for r in series.select("s", run(F.col("y"), F.lit(0.2), F.lit(0.3)).alias("f")).collect()}
    for key, ys in {"a": [1.5, 0.5, None, 0.2], "b": [None, None, 4.0, None]}.items():
        m, p, ll = 0.0, 10.0, 0.0
        for i, y in enumerate(ys):
            m, p = m + (0.1 if i < 2 else -0.5), p + 0.2
            if y is not None:
                ll -= 0.5 * (math.log(2 * math.pi * (p + 0.3)) + (y - m) ** 2 / (p + 0.3))
                gain = p / (p + 0.3)
                m, p = m + gain * (y - m), (1 - gain) * p
            assert got[key]["path"][i]["mean"] == pytest.approx(m)
            assert got[key]["path"][i]["var"] == pytest.approx(p)
        assert got[key]["loglik"] == pytest.approx(ll)


def test_error_split_reaches_the_best_of_a_fine_grid(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g, (q, r) in {"calm": (0.02, 0.3), "wild": (0.4, 0.05)}.items():
        for i in range(40):
            x = 0.0
            for year in range(2000, 2012):
                x += 0.1 + rng.normal() * math.sqrt(q)
                if rng.random() < 0.8:
                    rows.append((f"{g}-{i}", year, float(x + rng.normal() * math.sqrt(r))))
    df = spark.createDataFrame(rows, "s string, year int, v double")
    series = fit.annual_series(df, "s", "year", F.col("v"), 2000, 2011).withColumn("g", F.split("s", "-")[0]).cache()
    args = ({0: 0.1}, [(0, None, None)], 2000)
    run = lambda steps: {r["g"]: r for r in fit.em_error_split(series, "g", "y", *args, steps=steps).collect()}
    before, found = run(10), run(40)
    grid = [(q, r) for q in (0.01, 0.02, 0.03, 0.3, 0.4, 0.5) for r in (0.02, 0.05, 0.08, 0.25, 0.3, 0.35)]
    for g in ("calm", "wild"):
        own = series.where(F.col("g") == g)
        best = max(r["loglik"] for r in fit.error_split(own, grid, lambda y, q, r: fit.local_level_filter(y, q, r, *args)).collect())
        # the likelihood never falls, and ends near the grid's best or above
        assert found[g]["loglik"] >= before[g]["loglik"] - 1e-9
        assert found[g]["loglik"] >= best - 0.5
        assert found[g]["n_series"] == 40


def test_fit_with_thresholds_is_that_of_its_rows(design):
    """Thresholds made in each step give the fit of the rows with all of them; a step keeps the surveys where they are."""
    _, df = design
    three = df.withColumn("level", F.least(F.col("y"), F.lit(3.0)).cast("int") + 1)
    args = ({"cut": 3, "year_id": 4}, ["x"], "site_id", "above", "logistic")
    whole = fit.fit_mixed(fit.with_thresholds(three, "level", 4), *args, sd=3.0, site_sd=3.0)
    found = fit.fit_mixed(three, *args, sd=3.0, site_sd=3.0, thresholds=("level", 4))
    assert found.values.tolist() == pytest.approx(whole.values.tolist(), abs=1e-9)
    means = fit.fitted_means(three, found, "site_id", "logistic", ["cut", "year_id"], ["x"], ("level", 4))
    assert means.count() == 3 * three.count()
    cells, sites = fit._dealt(three, "site_id", ["year_id", "x"], "y")
    effects = sites.select(F.col("site").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own_part"))
    plan = cells.join(effects.hint("merge"), (F.col("site") == F.col("own")) & (F.col("part") == F.col("own_part")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.split("InMemoryTableScan")[0].count("Exchange") == 0  # the surveys' side comes first
    cells.unpersist()


def test_a_hot_site_is_fitted_in_parts(design, monkeypatch):
    _, df = design
    args = ({"year_id": 4}, ["x"], "site_id", "y", "poisson")
    whole = fit.fit_mixed(df, *args, sd=1.5, site_sd=0.7)
    monkeypatch.setattr(fit, "HOT", 300)
    assert fit._dealt(df, "site_id", ["year_id", "x"], "y")[0].groupBy("site").agg(F.count_distinct("part").alias("k")).agg(F.min("k")).first()[0] > 1
    cut = fit.fit_mixed(df, *args, sd=1.5, site_sd=0.7)
    assert cut.values.tolist() == pytest.approx(whole.values.tolist(), abs=1e-9)
