"""Queries over tables of model draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import links
from tidegrid.functions.recode import FIVE_LEVEL_COUNTS, SEVEN_LEVEL_COUNTS
from tidegrid.operators import checks, encode, posterior, ranks
from tidegrid.workload import views
from tidegrid.workload.registry import query, round_all, rounded

# Parameters of the stand-in: years of a path, the year before the first, regime of each year, periods compared.
SPAN = 22
BASE_YEAR = 1999
REGIME_CODES = [0] * 14 + [1] + [2] * 7
PRE, POST = (1, 14), (16, 22)
SEED = 73_421


def state_columns() -> dict:
    drift = {0: F.col("u_pre"), 1: F.col("u_crash"), 2: F.col("u_post")}
    x = posterior.state_path(F.col("x0"), F.col("dev"), F.col("sd_q"), drift, REGIME_CODES, 0)
    return {"x": x}


def states(spark, sf):
    """Draws with their state path ``x`` (array of 22)."""
    return views.params(spark, sf).withColumns(state_columns())


def layers(df):
    """Observed paths of the baseline and of two offset sources."""
    x, dev, sd = F.col("x"), F.col("obs_dev"), F.col("sd_r")
    return df.withColumns(
        {
            "obs_base": posterior.observed_path(x, dev, sd),
            "obs_b": posterior.observed_path(x, dev, sd, F.col("a_b")),
            "obs_c": posterior.observed_path(x, dev, sd, F.col("a_c")),
        }
    )


def ordinal_sql(x: str, levels: int) -> str:
    weights = FIVE_LEVEL_COUNTS if levels == 5 else SEVEN_LEVEL_COUNTS
    s = lambda k: f"(1 / (1 + exp(-(c{k} - ({x})))))"
    terms = [f"{weights[0]} * {s(1)}"]
    terms += [f"{weights[k - 1]} * ({s(k)} - {s(k - 1)})" for k in range(2, levels)]
    terms.append(f"{weights[-1]} * (1 - {s(levels - 1)})")
    return "(" + " + ".join(terms) + ")"


X5 = ordinal_sql("x", 5)


@query(
    "draws_long",
    "SELECT draw, CAST(i AS INTEGER) AS t, round(e[i], 9) + 0e0 AS value FROM draws, (SELECT unnest(generate_series(1, 64)) AS i)",
    ("draws",),
)
def draws_long(spark, sf):
    df = views.draws(spark, sf)
    long = posterior.long_by_position(df, ["draw"], {"e": F.col("e")})
    return round_all(long.drop("series"), "value", digits=9)


@query(
    "draws_wide",
    """
    SELECT CAST(i AS INTEGER) AS t, {} FROM (
      SELECT i, chain, avg(e[i]) AS m FROM draws, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY ALL) GROUP BY i
    """.format(", ".join(f"round(max(m) FILTER (WHERE chain = {c}), 9) + 0e0 AS chain_{c}" for c in range(4))),
    ("draws",),
)
def draws_wide(spark, sf):
    """Parameter by chain matrix, with an explicit list of pivot values."""
    long = posterior.long_by_position(views.draws(spark, sf), ["chain"], {"e": F.col("e")})
    wide = long.groupBy("t").pivot("chain", [0, 1, 2, 3]).agg(F.avg("value"))
    wide = wide.withColumnsRenamed({str(c): f"chain_{c}" for c in range(4)})
    return round_all(wide, *[f"chain_{c}" for c in range(4)], digits=9)


@query(
    "state_path",
    "SELECT draw, t, round(x, 8) + 0e0 AS value FROM states",
    ("states",),
)
def state_path(spark, sf):
    long = posterior.long_by_position(states(spark, sf), ["draw"], {"x": F.col("x")})
    return round_all(long.drop("series"), "value", digits=8)


@query(
    "observation_layer",
    """
    SELECT series, t, count(*) AS n, round(avg(v), 8) AS mean, round(min(v), 8) AS lowest, round(max(v), 8) AS highest
    FROM (SELECT 'base' AS series, t, x + dev_r * sd_r AS v FROM states
          UNION ALL SELECT 'b', t, a_b + x + dev_r * sd_r FROM states
          UNION ALL SELECT 'c', t, a_c + x + dev_r * sd_r FROM states) GROUP BY ALL
    """,
    ("states",),
)
def observation_layer(spark, sf):
    long = posterior.long_by_position(
        layers(states(spark, sf)), ["draw"],
        {"base": F.col("obs_base"), "b": F.col("obs_b"), "c": F.col("obs_c")},
    )
    out = long.groupBy("series", "t").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"),
    )
    return round_all(out, "mean", "lowest", "highest", digits=8)


@query(
    "inverse_link",
    "SELECT draw, t, round(1 / (1 + exp(-x)), 8) AS prob, round(exp(x), 8) AS rate FROM states",
    ("states",),
)
def inverse_link(spark, sf):
    long = posterior.long_by_position(states(spark, sf), ["draw"], {"x": F.col("x")})
    return long.select(
        "draw", "t",
        rounded(links.inv_logit("value"), 8).alias("prob"),
        rounded(F.exp("value"), 8).alias("rate"),
    )


def expected5(x):
    return links.ordinal_expected(x, F.col("cuts5"), FIVE_LEVEL_COUNTS)


def expected7(x):
    return links.ordinal_expected(x, F.col("cuts7"), SEVEN_LEVEL_COUNTS)


@query(
    "ordinal_expected_count",
    f"SELECT draw, t, round({X5}, 6) AS expected FROM states",
    ("states",),
)
def ordinal_expected_count(spark, sf):
    long = posterior.long_by_position(states(spark, sf), ["draw", "cuts5"], {"x": F.col("x")})
    return long.select("draw", "t", rounded(expected5(F.col("value"))).alias("expected"))


@query(
    "ordinal_expected_count_k7",
    f"SELECT draw, t, round({ordinal_sql('x', 7)}, 6) AS expected FROM states",
    ("states",),
)
def ordinal_expected_count_k7(spark, sf):
    long = posterior.long_by_position(states(spark, sf), ["draw", "cuts7"], {"x": F.col("x")})
    return long.select("draw", "t", rounded(expected7(F.col("value"))).alias("expected"))


@query(
    "baseline_rescale",
    f"""
    SELECT draw, t, round({ordinal_sql('x + dev_r * sd_r', 5)}, 6) AS expected, round(a_b, 8) + 0e0 AS a FROM states
    """,
    ("states",),
)
def baseline_rescale(spark, sf):
    """A source's yearly estimate less its offset, on the baseline's count scale."""
    df = layers(states(spark, sf))
    long = posterior.long_by_position(df, ["draw", "cuts5", "a_b"], {"b": F.col("obs_b")})
    rescaled = expected5(F.col("value") - F.col("a_b"))
    return long.select(
        "draw", "t", rounded(rescaled).alias("expected"), rounded("a_b", 8).alias("a")
    )


# years in which each source was sampled, as positions; source b has a gap before its last year
SAMPLED = {"b": [t for t in range(2, SPAN + 1) if t != 21], "c": list(range(10, SPAN + 1))}


def index_long(spark, sf):
    """Link-scale draws of state and sources turned into counts, in long form."""
    df = layers(states(spark, sf)).withColumns(
        {
            "state": F.transform("x", lambda v: expected5(v)),
            "base": F.transform("obs_base", lambda v: expected5(v)),
            "b": F.transform("obs_b", lambda v: expected5(v - F.col("a_b"))),
            "b_own": F.transform("obs_b", lambda v: expected7(v)),
            "c_own": F.transform("obs_c", lambda v: F.exp(v)),
        }
    )
    names = ["state", "base", "b", "b_own", "c_own"]
    long = posterior.long_by_position(df, ["draw"], {n: F.col(n) for n in names})
    sampled = F.lit(True)
    for series, source in (("b", "b"), ("b_own", "b"), ("c_own", "c")):
        sampled = sampled & ((F.col("series") != series) | F.col("t").isin(*SAMPLED[source]))
    return long.where(sampled).withColumn("year", F.col("t") + BASE_YEAR).drop("t"), names


def _sampled_sql(source: str) -> str:
    return "t IN ({})".format(", ".join(map(str, SAMPLED[source])))


@query(
    "annual_index",
    f"""
    WITH long AS (
      SELECT 'state' AS series, t, {X5} AS v FROM states
      UNION ALL SELECT 'base', t, {ordinal_sql('x + dev_r * sd_r', 5)} FROM states
      UNION ALL SELECT 'b', t, {ordinal_sql('x + dev_r * sd_r', 5)} FROM states WHERE {_sampled_sql('b')}
      UNION ALL SELECT 'b_own', t, {ordinal_sql('a_b + x + dev_r * sd_r', 7)} FROM states WHERE {_sampled_sql('b')}
      UNION ALL SELECT 'c_own', t, exp(a_c + x + dev_r * sd_r) FROM states WHERE {_sampled_sql('c')}),
    index AS (SELECT series, t, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.025) AS lower,
                     quantile_cont(v, 0.975) AS upper FROM long GROUP BY series, t)
    SELECT n.series, y.year, round(median, 6) AS median, round(lower, 6) AS lower, round(upper, 6) AS upper
    FROM (SELECT CAST(unnest(generate_series(2000, 2021)) AS INTEGER) AS year) y
    CROSS JOIN (SELECT unnest(['state', 'base', 'b', 'b_own', 'c_own']) AS series) n
    LEFT JOIN index i ON i.series = n.series AND i.t = y.year - 1999
    """,
    ("states",),
)
def annual_index(spark, sf):
    long, names = index_long(spark, sf)
    index = posterior.annual_index(long, ["series", "year"])
    spine = encode.year_spine(spark, BASE_YEAR + 1, BASE_YEAR + SPAN)
    return round_all(posterior.on_spine(index, spine, names), "median", "lower", "upper")


@query(
    "posterior_interval",
    """
    SELECT t, round(quantile_cont(p, 0.5), 8) AS median, round(quantile_cont(p, 0.025), 8) AS lower,
           round(quantile_cont(p, 0.975), 8) AS upper
    FROM (SELECT t, 1 / (1 + exp(-x)) AS p FROM states) GROUP BY t
    """,
    ("states",),
)
def posterior_interval(spark, sf):
    long = posterior.long_by_position(states(spark, sf), ["draw"], {"x": F.col("x")})
    probs = long.select("t", links.inv_logit("value").alias("value"))
    return round_all(posterior.annual_index(probs, ["t"]), "median", "lower", "upper", digits=8)


def change_rows(spark, sf):
    """One row per draw: mean before, mean after and their ratio, on both scales."""
    df = states(spark, sf).withColumns(
        {
            "count": F.transform("x", lambda v: expected5(v)),
            "presence": F.transform("x", lambda v: links.inv_logit(v)),
        }
    )
    scale = lambda name: F.struct(
        F.lit(name).alias("scale"),
        posterior.mean_between(F.col(name), *PRE).alias("mean_pre"),
        posterior.mean_between(F.col(name), *POST).alias("mean_post"),
    )
    rows = df.select("draw", F.explode(F.array(scale("count"), scale("presence"))).alias("s"))
    rows = rows.select("draw", "s.*")
    return rows.withColumn("change", F.try_divide("mean_post", "mean_pre") - 1.0)


@query(
    "period_change_posterior",
    f"""
    SELECT scale, round(quantile_cont(post / pre - 1, 0.5), 7) AS median,
           round(quantile_cont(post / pre - 1, 0.025), 7) AS lower,
           round(quantile_cont(post / pre - 1, 0.975), 7) AS upper
    FROM (SELECT scale, draw, avg(v) FILTER (WHERE t <= 14) AS pre, avg(v) FILTER (WHERE t >= 16) AS post
          FROM (SELECT 'count' AS scale, draw, t, {X5} AS v FROM states
                UNION ALL SELECT 'presence', draw, t, 1 / (1 + exp(-x)) FROM states) GROUP BY scale, draw)
    GROUP BY scale
    """,
    ("states",),
)
def period_change_posterior(spark, sf):
    index = ranks.exact_quantiles(
        change_rows(spark, sf), ["scale"], "change", ranks.interval_probs()
    )
    return round_all(index, "median", "lower", "upper", digits=7)


# --- convergence and summaries ------------------------------------------------------------


def long_params(spark, sf):
    df = views.draws(spark, sf)
    long = posterior.long_by_position(df, ["draw", "chain", "iteration"], {"e": F.col("e")})
    return long.withColumnRenamed("t", "param").drop("series")


RHAT_SQL = """
longp AS (SELECT draw, chain, iteration, CAST(i AS INTEGER) AS param, e[i] AS v
          FROM draws, (SELECT unnest(generate_series(1, 64)) AS i)),
sized AS (SELECT *, (SELECT max(iteration) + 1 FROM draws) AS len FROM longp),
halves AS (SELECT param, chain, h, avg(v) AS m, var_samp(v) AS s2, count(*) AS n FROM (
             SELECT *, CASE WHEN iteration < len // 2 THEN 0 WHEN iteration >= len - len // 2 THEN 1 END AS h FROM sized)
           WHERE h IS NOT NULL GROUP BY param, chain, h),
rhats AS (SELECT param, sqrt(var_samp(m) / avg(s2) + (max(n) - 1) / max(n)) AS rhat,
                 sum(n)::BIGINT AS n_draws FROM halves GROUP BY param)
"""


@query(
    "split_rhat",
    f"WITH {RHAT_SQL} SELECT param, round(rhat, 7) AS rhat, n_draws FROM rhats",
    ("draws",),
)
def split_rhat(spark, sf):
    return round_all(checks.split_rhat(long_params(spark, sf), "param", "value"), "rhat", digits=7)


@query(
    "rhat_flagged",
    f"WITH {RHAT_SQL} SELECT param, round(rhat, 7) AS rhat, n_draws FROM rhats WHERE round(rhat, 2) <> 1.00",
    ("draws",),
)
def rhat_flagged(spark, sf):
    flagged = checks.flag_unconverged(checks.split_rhat(long_params(spark, sf), "param", "value"))
    return round_all(flagged, "rhat", digits=7)


@query(
    "posterior_summary",
    """
    SELECT CAST(i AS INTEGER) AS param, round(avg(v), 8) + 0e0 AS mean, round(stddev_samp(v), 8) AS sd, count(v) AS n,
           round(quantile_cont(v, 0.025), 8) AS q2_5, round(quantile_cont(v, 0.25), 8) AS q25,
           round(quantile_cont(v, 0.5), 8) AS q50, round(quantile_cont(v, 0.75), 8) AS q75,
           round(quantile_cont(v, 0.975), 8) AS q97_5
    FROM (SELECT i, e[i] AS v FROM draws, (SELECT unnest(generate_series(1, 64)) AS i)) GROUP BY i
    """,
    ("draws",),
)
def posterior_summary(spark, sf):
    out = checks.parameter_summary(long_params(spark, sf), "param", "value")
    return round_all(out, "mean", "sd", "q2_5", "q25", "q50", "q75", "q97_5", digits=8)


@query(
    "ppc_sample",
    f"""
    SELECT draw, chain, iteration, round(e[1], 9) + 0e0 AS value FROM draws
    ORDER BY ('0x' || substr(md5(concat_ws('|', {SEED}, draw)), 1, 8))::UBIGINT, draw LIMIT 50
    """,
    ("draws",),
)
def ppc_sample(spark, sf):
    sampled = posterior.sample_draws(views.draws(spark, sf), 50, SEED)
    return sampled.select("draw", "chain", "iteration", rounded(F.col("e")[0], 9).alias("value"))
