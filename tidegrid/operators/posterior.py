"""Tables of model draws: state paths, observation layers, indices, per-survey predictors.

A draw is one row.  Vector parameters are arrays, so everything that stays inside a draw is a
row expression without a shuffle; only summaries over draws shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.functions.links import md5_uniform
from tidegrid.operators.ranks import exact_quantiles, interval_probs


def state_path(
    x0: Column, dev: Column, sd: Column, drift: dict[object, Column], regimes: list, first: object
) -> Column:
    """Array x with x[t] = x[t-1] + drift of t's regime + dev[t] * sd.

    ``regimes`` gives the regime code of each position; position 1 always uses ``first``.
    """

    def drift_at(i: Column) -> Column:
        out = drift[first]
        for code, column in drift.items():
            positions = [t for t, r in enumerate(regimes) if r == code and t > 0]
            if code != first and positions:
                out = F.when(i.isin(*positions), column).otherwise(out)
        return out

    steps = F.transform(dev, lambda d, i: drift_at(i) + d * sd)
    start = F.array().cast("array<double>")
    return F.aggregate(
        steps,
        start,
        lambda path, step: F.concat(
            path, F.array(F.coalesce(F.try_element_at(path, F.lit(-1)), x0) + step)
        ),
    )


def state_path_by(x0: Column, dev: Column, sd: Column, drift: Column, regime: Column) -> Column:
    """The same with regimes from data: ``regime`` is an array with the code (0, 1, ...) of each position, ``drift``
    one with the drift of each code.  Position 1 takes the first drift; a code that is null or has no drift stops the job."""
    unknown = F.raise_error(F.lit("a year has no known regime")).cast("double")
    steps = F.transform(
        F.arrays_zip(dev.alias("d"), regime.alias("r")),
        lambda s, i: F.when(i == 0, F.get(drift, F.lit(0))).otherwise(F.coalesce(F.get(drift, s["r"]), unknown)) + s["d"] * sd,
    )
    return F.aggregate(
        steps, F.array().cast("array<double>"),
        lambda path, step: F.concat(path, F.array(F.coalesce(F.try_element_at(path, F.lit(-1)), x0) + step)),
    )


def observed_path(
    x: Column, dev: Column, sd: Column, offset: Column | None = None, index: Column | None = None
) -> Column:
    """Array of (offset +) x[t] + dev[i] * sd, one value for each year i in which a source was sampled.

    ``index`` gives the position t of each sampled year in x; without it every year was sampled, and
    x and dev must be of one length.
    """
    if index is None:
        fits = F.when(F.size(x) == F.size(dev), dev).otherwise(F.raise_error(F.lit("a deviation for every year is needed")))
        layer = F.zip_with(x, fits, lambda a, d: a + d * sd)
    else:
        layer = F.zip_with(index, dev, lambda t, d: F.element_at(x, t) + d * sd)
    if offset is None:
        return layer
    return F.transform(layer, lambda v: v + offset)


def long_by_position(df: DataFrame, keep: list[str], values: dict[str, Column]) -> DataFrame:
    """(keep, series, t, value) rows from array columns; ``t`` starts at 1."""
    tagged = F.array(
        *[F.struct(F.lit(name).alias("series"), arr.alias("v")) for name, arr in values.items()]
    )
    one = df.select(*keep, F.explode(tagged).alias("__s"))
    return one.select(*keep, "__s.series", F.posexplode("__s.v").alias("t", "value")).withColumn(
        "t", F.col("t") + 1
    )


def annual_index(long: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """Median and interval over draws per series and year."""
    return exact_quantiles(long, keys, "value", interval_probs(level))


def on_spine(index: DataFrame, spine: DataFrame, series: list[str]) -> DataFrame:
    """Every series on every year; years without an estimate are NULL."""
    names = F.array(*[F.lit(s) for s in series])
    return spine.withColumn("series", F.explode(names)).join(index, ["series", "year"], "left")


def mean_between(values: Column, first: int, last: int) -> Column:
    """Mean of positions first..last of an array."""
    part = F.slice(values, first, last - first + 1)
    return F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v) / F.size(part)


def sample_draws(df: DataFrame, k: int, seed: int, draw: str = "draw") -> DataFrame:
    """k draws without replacement: the lowest md5 uniforms, a top-k that needs no full sort."""
    return df.orderBy(md5_uniform(seed, draw), draw).limit(k)


#: Draws that share an array.
DRAW_BLOCK = 256
MISSING = "an observation has an id that the draws have no effect for"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Hash-partition narrow rows before a step that costs far more per row than a shuffle does.

    As many partitions as the input has files, and as there are cores, at least; the explicit number
    keeps adaptive execution from merging them again.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, len(df.inputFiles()))
    return df.repartition(n, *by)


class DrawEffects:
    """Draws laid out for walking observations draw by draw, any number of them.

    Draws are cut into blocks of DRAW_BLOCK numbers.  Each vector parameter is a table with one row per id
    and block that holds the effects of the block's draws as an array; scalars have one row per block.
    An observation meets them through equi-joins on (id, block), and the walk over a block's draws is
    reduced in the same stage.  Nothing is fetched to the driver.
    """

    def __init__(self, draws: DataFrame, effects: dict[str, str], scalars: list[str]):
        self.effects = effects
        block = F.floor(F.col("draw") / DRAW_BLOCK).alias("__block")
        self._tables = {}
        for values, index in effects.items():
            long = draws.select("draw", block, F.posexplode(values).alias("__p", "__v"))
            self._tables[values] = long.groupBy((F.col("__p") + 1).alias(index), "__block").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("draw", "__v"))), lambda s: s["__v"]).alias(values)
            )
        self._scalars = draws.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("draw", *scalars))).alias("__scalars"))

    def per_draw(self, obs: DataFrame) -> DataFrame:
        """One row per observation and draw: struct ``p`` of scalars, and one value per vector parameter
        under its own name.  Meant to be aggregated in the same stage.

        An observation whose id has no effect stops the job: it must not drop out of a likelihood.
        """
        out, keys = obs, []
        for values, index in self.effects.items():
            table = self._tables[values].withColumnsRenamed({index: "__id", **{k: f"__r{k}" for k in keys}})
            same = F.col(index) == F.col("__id")
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"__r{k}"))
            out = out.join(table, same, "left").drop("__id", *[f"__r{k}" for k in keys])
            keys = ["__block"]
        out = out.join(self._scalars, "__block", "left")
        walked = out.select("*", F.posexplode_outer("__scalars").alias("__j", "p"))
        held = {
            v: F.coalesce(F.get(F.col(v), F.col("__j")), F.raise_error(F.lit(MISSING)).cast("double")) for v in self.effects
        }
        return walked.withColumns(held).drop("__j", "__block", "__scalars")
