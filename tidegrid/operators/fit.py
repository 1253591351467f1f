"""Fits of the survey models by Fisher scoring with a block of site effects, and a local-level filter.

The site effects, one for each of any number of sites, are eliminated from each step by their diagonal block (a Schur
complement): per-site sums come from a group-by, the step of the small block of other coefficients is solved on the driver
from one matrix of their number, and the sites' own steps follow from it as a column expression.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.functions.links import inv_logit, ordinal_expected
from tidegrid.functions.recode import regime_of
from tidegrid.sources.tables import materialise


@dataclasses.dataclass
class Fit:
    """Coefficients of the small block by (term, id), effects of the sites (site, effect), and how far the last step went."""

    names: list[tuple[str, int]]
    values: np.ndarray
    sites: DataFrame
    last_step: float

    def coefficients(self) -> DataFrame:
        rows = [(t, i, float(v)) for (t, i), v in zip(self.names, self.values)]
        return self.sites.sparkSession.createDataFrame(rows, "term string, id int, coefficient double")


def _mean(eta: np.ndarray, family: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and weight of one survey: canonical links, so the score is observed less mean."""
    if family == "logistic":
        mu = 1 / (1 + np.exp(-eta))
        return mu, mu * (1 - mu)
    mu = np.exp(np.minimum(eta, 50))
    return mu, mu


def _site_sums(beta: np.ndarray, names: list[tuple[str, int]], levels: dict[str, int], numeric: list[str], family: str):
    """Per site of a batch: weight, score and weighted covariates; and once a task the sums over all of its rows.

    The blocks of ids are counted, not spread to columns of zeros and ones.
    """
    p, first = len(names), {}
    for i, (term, _) in enumerate(names):
        first.setdefault(term, i)
    span = {term: slice(first[term], first[term] + n) for term, n in levels.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, matrix = np.zeros(p), np.zeros((p, p))
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            ids = {term: get(term).astype(np.int64) - 1 for term in levels}
            if any(((at < 0) | (at >= levels[term])).any() for term, at in ids.items()):
                raise ValueError("an id is outside of its block")
            z = {term: get(term).astype(float) for term in numeric}
            n, eta = get("n").astype(float), get("effect").astype(float)
            for term, at in ids.items():
                eta = eta + beta[span[term]][at]
            for term, v in z.items():
                eta = eta + v * beta[first[term]]
            mu, w = _mean(eta, family)
            w, r = w * n, get("total") - mu * n
            site, which = np.unique(get("site"), return_inverse=True)
            k = len(site)
            own = np.empty((k, p + 2))
            own[:, 0], own[:, 1] = np.bincount(which, w, k), np.bincount(which, r, k)
            terms = list(levels)
            for i, s in enumerate(terms):
                at, size = ids[s], levels[s]
                per_site = np.bincount(which * size + at, w, k * size).reshape(k, size)
                own[:, 2:][:, span[s]] = per_site
                score[span[s]] += np.bincount(at, r, size)
                matrix[span[s], span[s]] += np.diag(per_site.sum(0))
                for t in terms[i + 1:]:
                    both = np.bincount(at * levels[t] + ids[t], w, size * levels[t]).reshape(size, levels[t])
                    matrix[span[s], span[t]] += both
                    matrix[span[t], span[s]] += both.T
            for i, s in enumerate(numeric):
                at, weighted = first[s], w * z[s]
                own[:, 2 + at] = np.bincount(which, weighted, k)
                score[at] += r @ z[s]
                for t in terms:
                    sums = np.bincount(ids[t], weighted, levels[t])
                    matrix[at, span[t]] += sums
                    matrix[span[t], at] += sums
                for t in numeric[i:]:
                    both = weighted @ z[t]
                    matrix[at, first[t]] += both
                    if s != t:
                        matrix[first[t], at] += both
            yield pa.RecordBatch.from_arrays([pa.array(site, pa.int64()), pa.array(own.tolist(), pa.list_(pa.float64()))], ["site", "sums"])
        whole = np.concatenate([score, matrix.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([whole.tolist()], pa.list_(pa.float64()))], ["site", "sums"])

    return run


def _schur(p: int, penalty: float):
    """What the sites' block takes from the matrix and the score of the small block, over the sites of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 2)
                score = sums[:, 1] - penalty * batch.column("effect").to_numpy(zero_copy_only=False)
                b, size = sums[:, 2:], sums[:, 0] + penalty
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.concatenate([b.T @ (score / size), (b.T / size @ b).ravel()]).tolist()], pa.list_(pa.float64()))], ["sums"]
                )

    return run


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    """Element-wise sums of arrays of one length."""
    long = rows.select(*keys, F.posexplode("sums").alias("p", "v")).groupBy(*keys, "p").agg(F.sum("v").alias("v"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("sums"))


#: Rows of a site that one task takes.
HOT = 1 << 20


def _dealt(df: DataFrame, site: str, columns: list[str], y: str) -> tuple[DataFrame, DataFrame]:
    """(cells, sites): rows of ``df`` with a ``y``, those that agree in ``columns`` as one, kept by site for steps that
    come back to them; and every site with its ``parts``, more than one for a site of over HOT rows."""
    rows = df.where(F.col(y).isNotNull()).select(F.col(site).cast("bigint").alias("site"), *columns, F.col(y).alias("__y"))
    sites = materialise(rows.where("site IS NOT NULL").groupBy("site").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")))
    hot = sites.where("parts > 1").agg(F.map_from_entries(F.collect_list(F.struct("site", "parts")))).scalar()  # at most a row for every HOT surveys
    cuts = F.coalesce(F.try_element_at(hot, F.col("site")), F.lit(1))
    part = F.pmod(F.xxhash64(*columns), cuts).cast("int")
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.withColumn("part", part).repartition(n, "site", "part")
    cells = dealt.groupBy("site", "part", *columns).agg(F.count(F.lit(1)).alias("n"), F.sum("__y").cast("double").alias("total"))
    cells = cells.sortWithinPartitions("site", "part").persist()
    cells.count()  # the planner knows how a cached table is dealt once it is there, and leaves it so
    return cells, sites


def fit_mixed(
    df: DataFrame, levels: dict[str, int], numeric: list[str], site: str, y: str, family: str, sd: float, site_sd: float,
    tolerance: float = 1e-9, most: int = 40, thresholds: tuple[str, int] | None = None,
) -> Fit:
    """Penalised logistic or Poisson (log link) regression of ``y`` on blocks of 1-based ids, numeric columns and sites.

    Normal priors: ``sd`` for the small block and ``site_sd`` for the sites.  Surveys that agree in everything are summed
    first, dealt by site once and cached there, so that a step moves only effects and sums per site; of them only the small
    block's come to the driver.  ``thresholds`` names a level and how many there are: the rows of the fit are then those of
    ``with_thresholds``, made anew in each step, and ``y`` is its ``above``.
    """
    names = [(t, i) for t, n in levels.items() for i in range(1, n + 1)] + [(t, 0) for t in numeric]
    p, beta = len(names), np.zeros(len(levels) and sum(levels.values()) + len(numeric) or len(numeric))
    if thresholds is None:
        kept, sites = _dealt(df, site, [*levels, *numeric], y)
        cells = kept
    else:
        level, count = thresholds
        kept, sites = _dealt(df, site, [*(t for t in levels if t != "cut"), *numeric, level], level)
        cells = with_thresholds(kept, level, count).withColumn("total", F.col("above") * F.col("n"))
    try:
        return _steps(cells, sites, beta, names, p, levels, numeric, family, sd, site_sd, tolerance, most)
    finally:
        kept.unpersist()


def _steps(cells, sites, beta, names, p, levels, numeric, family, sd, site_sd, tolerance, most) -> Fit:
    effects = sites.select("site", "parts", F.lit(0.0).alias("effect"))
    ridge, own = 1 / sd**2, 1 / site_sd**2
    for _ in range(most):
        at = effects.withColumnRenamed("site", "own_site")
        placed = at.select("own_site", "effect", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own_part"))
        rows = cells.join(placed, (F.col("site") == F.col("own_site")) & (F.col("part") == F.col("own_part")))
        rows = rows.select("site", *levels, *numeric, "n", "total", "effect")
        parts = rows.mapInArrow(_site_sums(beta, names, levels, numeric, family), "site bigint, sums array<double>")
        sums = materialise(_added(parts, "site"))
        whole = np.array(sums.where("site IS NULL").first()["sums"])
        per_site = sums.where("site IS NOT NULL").join(at, F.col("site") == F.col("own_site")).drop("own_site")
        taken = np.array(_added(per_site.select("sums", "effect").mapInArrow(_schur(p, own), "sums array<double>")).first()["sums"])
        matrix = whole[p:].reshape(p, p) + ridge * np.eye(p) - taken[p:].reshape(p, p)
        step = np.linalg.solve(matrix, whole[:p] - ridge * beta - taken[:p])
        scale = min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        moved = F.aggregate(F.zip_with(F.slice("sums", 3, p), F.array(*[F.lit(float(v)) for v in step]), lambda b, d: b * d), F.lit(0.0), lambda a, v: a + v)
        site_step = (F.element_at("sums", 2) - F.col("effect") * own - moved) / (F.element_at("sums", 1) + own)
        beta = beta + scale * step
        stepped = materialise(per_site.select("site", "parts", (F.col("effect") + site_step * scale).alias("effect"), F.abs(site_step).alias("step")))
        effects = stepped.select("site", "parts", "effect")
        last = max(float(np.abs(step).max()), float(stepped.agg(F.max("step")).first()[0]))
        if last < tolerance:
            break
    return Fit(names, beta, effects.select("site", "effect"), last)


def fitted_means(
    df: DataFrame, fit: Fit, site: str, family: str, levels: list[str], numeric: list[str], thresholds: tuple[str, int] | None = None,
) -> DataFrame:
    """``df`` with ``fitted``, the mean of each row under the fit; with ``thresholds``, of each survey and threshold, made
    after the sites' effects are joined."""
    eta = F.col("__effect")
    for term in levels:
        values = {i: float(v) for (t, i), v in zip(fit.names, fit.values) if t == term}
        eta = eta + F.element_at(F.array(*[F.lit(values[i + 1]) for i in range(len(values))]), F.col(term).cast("int"))
    for term in numeric:
        eta = eta + F.col(term) * float(fit.values[fit.names.index((term, 0))])
    at = fit.sites.select(F.col("site").alias("__site"), F.col("effect").alias("__effect"))
    mean = inv_logit(eta) if family == "logistic" else F.exp(eta)
    held = df.join(at, F.col(site) == F.col("__site"))
    rows = held if thresholds is None else with_thresholds(held, *thresholds)
    return rows.withColumn("fitted", mean).drop("__site", "__effect")


def with_thresholds(df: DataFrame, level: str, k: int) -> DataFrame:
    """A row for each survey and threshold (``cut`` 1 to k - 1), ``above`` telling if the level lies above it."""
    cuts = F.explode(F.array(*[F.lit(i) for i in range(1, k)])).alias("cut")
    return df.select("*", cuts).withColumn("above", (F.col(level) > F.col("cut")).cast("double"))


def dispersion(rows: DataFrame, y: str, mean: str) -> Column:
    """NB2 dispersion by moments, as an aggregate."""
    m, v = F.col(mean), F.col(y)
    return F.try_divide(F.sum(m * m), F.sum((v - m) * (v - m) - m))


# --- local-level model with regime drift --------------------------------------------------


def annual_series(df: DataFrame, key: str, year: str, value: Column, first: int, last: int) -> DataFrame:
    """One row per series: array of yearly means over the span, NULL where not sampled.

    Surveys are averaged per series and year first, so the gathered list is never longer than
    the span.
    """
    annual = df.groupBy(key, year).agg(F.avg(value).alias("__y"))
    by_year = annual.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(year), F.col("__y")))).alias("__m")
    )
    years = F.sequence(F.lit(first), F.lit(last))
    return by_year.select(key, F.transform(years, lambda y: F.try_element_at("__m", y)).alias("y"))


def local_level_filter(
    y: Column, q: Column, r: Column, drift: dict[object, float], regimes, first_year: int,
    m0: float = 0.0, p0: float = 10.0,
) -> Column:
    """Kalman filter as a fold over the yearly values: struct of log-likelihood and path.

    x[t] = x[t-1] + drift + N(0, q);  y[t] = x[t] + N(0, r).  A NULL year is predicted only.
    """
    drifts = F.create_map(*[F.lit(v) for pair in drift.items() for v in pair])
    steps = F.transform(
        y,
        lambda v, i: F.struct(
            v.alias("y"), F.element_at(drifts, regime_of(i + first_year, regimes)).alias("u"), i.alias("i")
        ),
    )
    point = "array<struct<year:int,mean:double,var:double>>"
    start = F.struct(
        F.lit(m0).alias("m"), F.lit(p0).alias("p"), F.lit(0.0).alias("loglik"),
        F.array().cast(point).alias("path"),
    )

    def step(acc: Column, s: Column) -> Column:
        m, p = acc["m"] + s["u"], acc["p"] + q
        total = p + r
        resid = s["y"] - m
        gain = F.when(s["y"].isNull(), 0.0).otherwise(p / total)
        m_new = m + gain * F.coalesce(resid, F.lit(0.0))
        p_new = (F.lit(1.0) - gain) * p
        term = (F.log(total * (2 * math.pi)) + resid * resid / total) * -0.5
        here = F.struct(
            (s["i"] + first_year).alias("year"), m_new.alias("mean"), p_new.alias("var")
        )
        return F.struct(
            m_new.alias("m"), p_new.alias("p"),
            (acc["loglik"] + F.coalesce(term, F.lit(0.0))).alias("loglik"),
            F.concat(acc["path"], F.array(here)).alias("path"),
        )

    return F.aggregate(steps, start, step)


def local_level_smoother(
    y: Column, q: Column, r: Column, drift: dict[object, float], regimes, first_year: int, m0: float = 0.0, p0: float = 10.0,
) -> Column:
    """Backward pass over the filter's path: array of year, mean, var, and cov with the year after, from the year before the first on."""
    drifts = F.create_map(*[F.lit(v) for pair in drift.items() for v in pair])
    before = F.struct(F.lit(first_year - 1).alias("year"), F.lit(m0).alias("mean"), F.lit(p0).alias("var"))
    path = F.concat(F.array(before), local_level_filter(y, q, r, drift, regimes, first_year, m0, p0)["path"])
    last = F.element_at(path, -1)
    point = F.struct(last["year"].alias("year"), last["mean"].alias("mean"), last["var"].alias("var"), F.lit(0.0).alias("cov"))

    def step(later: Column, s: Column) -> Column:
        after = later[0]
        u = F.element_at(drifts, regime_of(s["year"] + 1, regimes))
        gain = s["var"] / (s["var"] + q)
        here = F.struct(
            s["year"].alias("year"), (s["mean"] + gain * (after["mean"] - s["mean"] - u)).alias("mean"),
            (s["var"] + gain * gain * (after["var"] - s["var"] - q)).alias("var"), (gain * after["var"]).alias("cov"),
        )
        return F.concat(F.array(here), later)

    return F.aggregate(F.reverse(F.slice(path, 1, F.size(path) - 1)), F.array(point), step)


def em_error_split(
    series: DataFrame, group: str, y: str, drift: dict[object, float], regimes, first_year: int, start: tuple[float, float] = (0.1, 0.1), steps: int = 25,
) -> DataFrame:
    """(group, q, r, loglik, n_series): process and observation variance of each group of series, by expectation maximisation.

    A step smooths every series under its group's variances and takes the expected squares of the states' and the
    observations' errors, summed per group; the log likelihood, of the variances that a step began with, never falls.
    """
    groups = materialise(series.select(F.col(group).alias("__g"), F.lit(float(start[0])).alias("q"), F.lit(float(start[1])).alias("r")).distinct())
    drifts = F.create_map(*[F.lit(v) for pair in drift.items() for v in pair])
    args = (drift, regimes, first_year)
    for _ in range(steps):
        held = series.join(groups.select("__g", "q", "r"), F.col(group).eqNullSafe(F.col("__g")))
        q, r = F.col("q"), F.col("r")
        smooth = held.select(
            group, "q", "r", F.col(y).alias("y"), local_level_smoother(F.col(y), q, r, *args).alias("s"), local_level_filter(F.col(y), q, r, *args)["loglik"].alias("ll")
        )
        n = F.size("y")
        at = lambda i: F.get("s", i)
        moved = lambda i: at(i)["mean"] - at(i - 1)["mean"] - F.element_at(drifts, regime_of(at(i)["year"], regimes))
        steps_of = F.transform(F.sequence(F.lit(1), n), lambda i: moved(i) * moved(i) + at(i)["var"] + at(i - 1)["var"] - at(i - 1)["cov"] * 2)
        seen = F.zip_with("y", F.slice("s", 2, n), lambda v, p: (v - p["mean"]) * (v - p["mean"]) + p["var"])
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
        sums = smooth.select(group, "ll", total(steps_of).alias("moved"), n.alias("n"), total(seen).alias("seen"), F.size(F.filter("y", lambda v: v.isNotNull())).alias("n_seen"))
        groups = materialise(
            sums.groupBy(F.col(group).alias("__g")).agg(
                (F.sum("moved") / F.sum("n")).alias("q"), F.try_divide(F.sum("seen"), F.sum("n_seen")).alias("r"), F.sum("ll").alias("loglik"), F.count(F.lit(1)).alias("n_series")
            )
        )
    return groups.withColumnRenamed("__g", group)


def error_split(series: DataFrame, grid: list[tuple[float, float]], run) -> DataFrame:
    """Total log-likelihood over all series for each (q, r) pair of a grid."""
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(r).alias("r")) for q, r in grid])
    rows = series.withColumn("__g", F.explode(pairs))
    out = run(F.col("y"), F.col("__g.q"), F.col("__g.r"))
    return rows.select(F.col("__g.q").alias("q"), F.col("__g.r").alias("r"), out["loglik"].alias("ll")).groupBy(
        "q", "r"
    ).agg(F.sum("ll").alias("loglik"), F.count(F.lit(1)).alias("n_series"))


def index_of(coefficients: DataFrame, term: str) -> DataFrame:
    """Coefficients of one block with their inverse-logit and exponential."""
    c = F.col("coefficient")
    rows = coefficients.where((F.col("term") == term) & (F.col("id") > 0))
    return rows.select("id", "coefficient", inv_logit(c).alias("probability"), F.exp(c).alias("rate"))


def expected_from_cuts(coefficients: DataFrame, term: str, weights: list[float]) -> DataFrame:
    """Expected count per id of a block of the ordinal fit."""
    cuts = coefficients.where((F.col("term") == "cut") & (F.col("id") > 0)).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("id", "coefficient"))), lambda s: -s["coefficient"]
        ).alias("cuts")
    )
    rows = index_of(coefficients, term).withColumn("__cuts", cuts.scalar())
    return rows.select(
        "id", "coefficient",
        ordinal_expected(F.col("coefficient"), F.col("__cuts"), weights).alias("expected"),
    )
