"""Model checks on tables: convergence, predictive replicates, residuals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidegrid.operators.lookup import join_null_safe
from tidegrid.operators.ranks import cumulative_counts, exact_quantiles


def split_rhat(long: DataFrame, param: str, value: str) -> DataFrame:
    """R-hat per parameter from chains cut in half (the middle draw of an odd chain is left out).

    Columns ``chain`` and ``iteration`` (0-based) are expected; all chains have one length.
    """
    length = long.agg((F.max("iteration") + 1).alias("n")).scalar()
    sized = long.withColumn("__len", length)
    half = F.floor(F.col("__len") / 2)
    part = F.when(F.col("iteration") < half, 0).when(
        F.col("iteration") >= F.col("__len") - half, 1
    )
    chains = (
        sized.withColumn("__half", part)
        .where(F.col("__half").isNotNull())
        .groupBy(param, "chain", "__half")
        .agg(
            F.avg(value).alias("__mean"),
            F.var_samp(value).alias("__var"),
            F.count(F.lit(1)).alias("__n"),
        )
    )
    n = F.max("__n")
    within = F.avg("__var")
    between = n * F.var_samp("__mean")
    return chains.groupBy(param).agg(
        F.sqrt(F.try_divide(between, within) / n + (n - 1) / n).alias("rhat"),
        F.sum("__n").alias("n_draws"),
    )


def flag_unconverged(rhat: DataFrame) -> DataFrame:
    """Parameters whose R-hat is not 1.00 after rounding."""
    return rhat.where(F.round("rhat", 2) != 1.0)


def parameter_summary(long: DataFrame, param: str, value: str) -> DataFrame:
    moments = long.groupBy(param).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )
    probs = {"q2_5": 0.025, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q97_5": 0.975}
    return moments.join(exact_quantiles(long, [param], value, probs), param)


def _negbin_counts(target: np.ndarray, mean: np.ndarray, size: np.ndarray) -> np.ndarray:
    ratio = mean / (mean + size)
    mass = np.exp(size * np.log(size / (mean + size)))
    cdf = mass.copy()
    count = np.zeros(len(target), dtype=np.int64)
    live = np.flatnonzero((target > cdf) & (mass > 0))
    while len(live):
        count[live] += 1
        k = count[live]
        mass[live] *= (k - 1 + size[live]) / k * ratio[live]
        cdf[live] += mass[live]
        # past the mean, a mass below one ulp can no longer move the CDF
        stuck = (mass[live] < 1e-18) & (k > mean[live])
        live = live[(target[live] > cdf[live]) & ~stuck]
    return count


def with_negbin_draw(df: DataFrame, u: str, mean: str, size: str, out: str) -> DataFrame:
    """``df`` with the inverse-CDF draw of an NB2 count from a uniform, mean and dispersion, a batch at a time.

    All columns of ``df`` pass through Python: hand over the needed ones only.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = (frame[c].to_numpy(dtype=float) for c in (u, mean, size))
            yield frame.assign(**{out: _negbin_counts(*values)})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def kernel_density(
    counts: DataFrame, keys: list[str], value: str, n: str, grid: list[float], bandwidth: float
) -> DataFrame:
    """Gaussian kernel density on a fixed grid from pre-aggregated (key, value, n) rows."""
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("at")
    z = (F.col("at") - F.col(value)) / bandwidth
    kernel = F.exp(z * z * -0.5) / (bandwidth * math.sqrt(2 * math.pi))
    return (
        counts.select(*keys, value, n, points)
        .groupBy(*keys, "at")
        .agg((F.sum(kernel * F.col(n)) / F.sum(n)).alias("density"))
    )


def quantile_residual(y: Column, sims: Column, u: Column) -> Column:
    """Where the observation falls among its replicates, ties spread by the uniform ``u``."""
    share = lambda test: F.size(F.filter(sims, test)) / F.size(sims)
    below = share(lambda s: s < y)
    upto = share(lambda s: s <= y)
    return below + u * (upto - below)


def array_median(values: Column) -> Column:
    """Median of a short array."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0


#: Parts that [0, 1] is cut into to find where the distance may lie.
PARTS = 4096


def ks_uniform(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance of the values (``weight`` times each) from the uniform distribution on [0, 1].

    Values are counted by parts of [0, 1] first.  A part's ends and the rows before it bound its distances from
    above, and its least and greatest value are distances already; only parts that may hold more than the greatest of
    these are ranked value by value, with no window over the whole table.
    """
    n = F.count(value) if weight is None else F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    counts = df.groupBy(*keys, value).agg(n.alias("__w")).where(F.col("__w") > 0)
    part = F.floor(F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0)) * PARTS)
    counts = counts.withColumn("__part", part)
    parts = counts.groupBy(*keys, "__part").agg(F.sum("__w").alias("__in"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    running = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*keys)  # at most PARTS + 1 rows a group
    parts = parts.withColumns({"__upto": F.sum("__in").over(running), "__total": F.sum("__in").over(group)})
    before, upto, total = F.col("__upto") - F.col("__in"), F.col("__upto"), F.col("__total")
    seen = F.greatest(upto / total - F.col("__hi"), F.col("__lo") - before / total)
    most = F.greatest(upto / total - F.col("__lo"), F.col("__hi") - before / total)
    wanted = parts.withColumns({"__most": most, "__seen": F.max(seen).over(group)}).where(F.col("__most") >= F.col("__seen"))
    # at most PARTS + 1 rows a group, so that the counts need no shuffle to meet them
    wanted = F.broadcast(wanted.select(*keys, "__part", before.alias("__before"), "__total"))
    held = join_null_safe(counts, wanted, [*keys, "__part"]).select(*keys, F.struct("__part", "__before", "__total").alias("__at"), value, "__w")
    ranked = cumulative_counts(held, [*keys, "__at"], value, "__w")
    cum = F.col("__at.__before") + F.col("cum")
    above, below = cum / F.col("__at.__total") - F.col(value), F.col(value) - (cum - F.col("n")) / F.col("__at.__total")
    return ranked.groupBy(*keys).agg(F.max(F.greatest(above, below)).alias("ks"), F.max("__at.__total").alias("n"))
