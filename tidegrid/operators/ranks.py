"""Exact ranks, quantiles and ids without gathering a group in one task.

Quantiles are found by radix selection: values become ordered whole numbers, and each pass counts them by digit
per group and goes on with the digits that hold a wanted rank only.  The first digit is that of the exponent; later ones
cut what is left, from its least to its greatest number, so narrow and wide data are cut alike.  Cumulative counts
need every rank; they cut each group into stretches of about STRETCH rows in the same way.  Counts per digit combine on
the map side, and what is sorted in one task at the end is one stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegrid.operators.lookup import join_null_safe
from tidegrid.sources.tables import materialise

#: Ordered numbers of one binary exponent, and digits of a pass after the first.
STEPS, DIGITS = 1 << 50, 4096
#: Passes of a selection after the first one.
PASSES = 2
#: Rows that are sorted together for cumulative counts, about.
STRETCH = 1 << 16


def ordered(value: Column) -> Column:
    """A whole number that never falls as the double rises; 0 for 0.  It tells apart what differs by 1e-12 of its size.

    Infinities and, above all, NaN come last (minus infinity first).
    """
    size = ((F.log2(F.abs(value)) + 1100.0) * float(STEPS)).cast("long")
    size = F.when(value == 0, 0).when(F.abs(value) == float("inf"), F.lit(2**62)).otherwise(size)
    return F.when(F.isnan(value), F.lit(2**62 + 1)).when(value < 0, -size).otherwise(size)


def _running(keys: list[Column | str], by: str) -> Window:
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def _first_digits(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group and exponent: rows (n), least and greatest number (lo, hi), rows before and in the whole group."""
    # the number is null with the value, so that the value's own expression is not worked out twice by a filter
    numbered = df.select(*keys, ordered(F.col(value)).alias("__k"))
    counted = numbered.groupBy(*keys, F.expr(f"__k div {STEPS}").alias("__e")).agg(
        F.count("__k").alias("n"), F.min("__k").alias("lo"), F.max("__k").alias("hi")
    ).where("n > 0")
    return counted.withColumns(
        {
            "before": F.coalesce(F.sum("n").over(_running(keys, "lo")), F.lit(0)),
            "total": F.sum("n").over(Window.partitionBy(*keys)),
        }
    )


def _rank_at(prob: float, total: Column, ceiling: bool) -> Column:
    at = (total - 1) * F.lit(float(prob))
    return (F.ceil(at) if ceiling else F.floor(at)).cast("long") + 1


def _wanted(stretches: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Of each group the stretches that hold a wanted rank, as one array."""
    before, upto, total = F.col("before"), F.col("before") + F.col("n"), F.col("total")
    ranks = [_rank_at(p, total, up) for p in probs for up in (False, True)]
    holds = F.lit(False)
    for rank in ranks:
        holds = holds | ((rank > before) & (rank <= upto))
    struct = F.struct("lo", "hi", "before", "total")
    return stretches.where(holds).groupBy(*keys).agg(F.collect_list(struct).alias("__wanted"))


def _inside(df: DataFrame, wanted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose number lies in a wanted stretch of their group, with that stretch (s)."""
    numbered = df.select(*keys, F.col(value), ordered(F.col(value)).alias("__k"))
    joined = join_null_safe(numbered, wanted, list(keys)) if keys else numbered.withColumn("__wanted", wanted.scalar())
    own = F.filter("__wanted", lambda s: (F.col("__k") >= s["lo"]) & (F.col("__k") <= s["hi"]))
    return joined.select(*keys, value, "__k", F.get(own, F.lit(0)).alias("s")).where(F.col("s").isNotNull())


def _next_digits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The stretches cut into DIGITS equal parts each."""
    digit = F.expr(f"(__k - s.lo) div ((s.hi - s.lo) div {DIGITS} + 1)")
    counted = rows.groupBy(*keys, F.col("s.lo").alias("__s"), digit.alias("__d")).agg(
        F.count(F.lit(1)).alias("n"), F.min("__k").alias("lo"), F.max("__k").alias("hi"),
        F.min("s.before").alias("__base"), F.min("s.total").alias("total"),
    )
    return counted.withColumn("before", F.col("__base") + F.coalesce(F.sum("n").over(_running([*keys, "__s"], "__d")), F.lit(0)))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Interpolated (type 7) quantiles per group; NULL values are ignored.

    ``df`` is read once a pass; only the stretches that hold a wanted rank are sorted at the end.
    """
    stretches = _first_digits(df, keys, value)
    wanted = _wanted(stretches, keys, list(probs.values()))
    for _ in range(PASSES):
        wanted = _wanted(_next_digits(_inside(df, wanted, keys, value), keys), keys, list(probs.values()))
    rows = _inside(df, wanted, keys, value).groupBy(*keys, "s", value).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*keys, "s.lo").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("__cum", F.col("s.before") + F.sum("__n").over(upto)).withColumn("__total", F.col("s.total"))

    ends = []
    for i, prob in enumerate(probs.values()):
        for tag, ceiling in (("lo", False), ("hi", True)):
            rank = _rank_at(prob, F.col("__total"), ceiling)
            ends.append(F.min(F.when(F.col("__cum") >= rank, F.col(value))).alias(f"__{tag}{i}"))
    found = ranked.groupBy(*keys).agg(F.max("__total").alias("__total"), *ends)

    out = list(keys)
    for i, (name, prob) in enumerate(probs.items()):
        pos = (F.col("__total") - 1) * F.lit(float(prob))
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((lo + (hi - lo) * frac).alias(name))
    return found.select(*out)


def cumulative_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Every distinct value of each group with ``n``, rows up to and including it (``cum``) and
    the group's size (``total``).  A row stands for ``weight`` rows."""
    n = F.count(value) if weight is None else F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    counts = df.groupBy(*keys, value).agg(n.alias("__n")).where(F.col("__n") > 0)
    counts = counts.withColumn("__k", ordered(F.col(value))).withColumn("__e", F.expr(f"__k div {STEPS}"))
    sums = counts.groupBy(*keys, "__e").agg(F.sum("__n").alias("n"), F.min("__k").alias("lo"), F.max("__k").alias("hi"))
    width = sums.withColumn("__width", F.expr(f"(hi - lo) div (n div {STRETCH} + 1) + 1")).select(*keys, "__e", "lo", "__width")
    placed = join_null_safe(counts, width, [*keys, "__e"]).withColumn("__s", F.expr("lo + (__k - lo) div __width * __width"))
    stretches = placed.groupBy(*keys, "__s").agg(F.sum("__n").alias("__in"))
    stretches = stretches.withColumns(
        {
            "__before": F.coalesce(F.sum("__in").over(_running(keys, "__s")), F.lit(0)),
            "total": F.sum("__in").over(Window.partitionBy(*keys)),
        }
    ).drop("__in")
    inside = Window.partitionBy(*keys, "__s").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return join_null_safe(placed, stretches, [*keys, "__s"]).select(
        *keys, value, F.col("__n").alias("n"), (F.col("__before") + F.sum("__n").over(inside)).alias("cum"), "total"
    )


def interval_probs(level: float = 0.95) -> dict[str, float]:
    tail = (1 - level) / 2
    return {"median": 0.5, "lower": tail, "upper": 1 - tail}


#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def dense_dictionary(df: DataFrame, column: str, id_name: str, keys: list[str] | None = None) -> DataFrame:
    """Sorted distinct values with ids 1..n (Spark's order, NaN last), per ``keys`` if given; NULL has no id.

    The distinct values are dealt by range, sorted within partitions and written with their places; how many lie in the
    partitions before gives each its offset, and the first place of a key the start of its own ids.
    """
    keys = keys or []
    order = [*keys, column]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(*order).where(F.col(column).isNotNull()).distinct()
    placed = values.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    stored = materialise(placed).withColumn("__part", F.shiftright("__m", ROW_BITS))
    sizes = stored.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__in"))
    running = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__in").over(running), F.lit(0)))
    place = F.col("__before") + F.col("__m").bitwiseAND(2**ROW_BITS - 1)
    numbered = stored.join(offsets, F.col("__part") == F.col("__p")).select(*order, place.alias("__at"))
    if not keys:
        return numbered.select(column, (F.col("__at") + 1).alias(id_name))
    firsts = numbered.groupBy(*keys).agg(F.min("__at").alias("__first"))
    return join_null_safe(numbered, firsts, keys).select(*order, (F.col("__at") - F.col("__first") + 1).alias(id_name))


def with_dense_id(
    df: DataFrame, column: str, id_name: str, keys: list[str] | None = None
) -> DataFrame:
    """Attach the 1-based rank of ``column`` among its sorted distinct values, per ``keys`` if given."""
    dictionary = dense_dictionary(df, column, id_name, keys)
    return join_null_safe(df, dictionary, [*(keys or []), column], "left")


def with_dense_ids(df: DataFrame, columns: dict[str, str], keys: list[str]) -> DataFrame:
    """Attach the 1-based rank of several columns (name to id name) among their sorted distinct values, per ``keys``.

    All columns are ranked in one job without a query of its own: their distinct values, a row each, are sorted
    per key and column.  NULL has no id.
    """
    kinds = [df.schema[c].dataType for c in columns]
    one = lambda c: F.struct(
        F.lit(c).alias("c"), *[(F.col(c) if c == k else F.lit(None)).cast(t).alias(f"v{i}") for i, (k, t) in enumerate(zip(columns, kinds))]
    )
    values = [f"v{i}" for i in range(len(columns))]
    listed = df.select(*keys, F.explode(F.array(*map(one, columns))).alias("s")).select(*keys, "s.*").distinct()
    listed = listed.where(F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull())
    ranked = listed.withColumn("__id", F.row_number().over(Window.partitionBy(*keys, "c").orderBy(*values)).cast("long"))
    out = df
    for v, (column, name) in zip(values, columns.items()):
        own = ranked.where(F.col("c") == column).select(*keys, F.col(v).alias(column), F.col("__id").alias(name))
        out = join_null_safe(out, own, [*keys, column], "left")
    return out


def numbered_within(
    df: DataFrame, keys: list[str], leading: str, then: list[str], out: str = "row"
) -> DataFrame:
    """Row number within each group, ordered by ``leading`` and then by the other columns.

    ``leading`` cuts the group: offsets come from counts per (group, leading), and only rows
    that share both are sorted together.
    """
    running = (
        Window.partitionBy(*keys).orderBy(leading).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        df.groupBy(*keys, leading)
        .agg(F.count(F.lit(1)).alias("__in"))
        .withColumn("__before", F.coalesce(F.sum("__in").over(running), F.lit(0)))
        .drop("__in")
    )
    inside = Window.partitionBy(*keys, leading).orderBy(*then)
    return (
        join_null_safe(df, offsets, [*keys, leading])
        .withColumn(out, (F.row_number().over(inside) + F.col("__before")).cast("long"))
        .drop("__before")
    )


def histogram(
    df: DataFrame, keys: list[str], value: str, bins: int, lo: Column, hi: Column, weight: str | None = None
) -> DataFrame:
    """Counts (or sums of ``weight``) in equal-width bins over [lo, hi]; the top edge belongs to the last bin."""
    width = (hi - lo) / bins
    raw = F.floor((F.col(value) - lo) / F.when(width > 0, width).otherwise(1.0)).cast("long")
    return (
        df.where(F.col(value).isNotNull())
        .withColumn("bin", F.least(raw, F.lit(bins - 1)))
        .groupBy(*keys, "bin")
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    )
