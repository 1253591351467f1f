"""Mixing sources to target weights by repetition rates.

Method: words are summed per source, each source's rate is target / size, and a document is emitted
floor(rate) times plus once more with the probability of the fraction, drawn from a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegrid.sources.tables import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MOST_COPIES = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """In [0, 1), from the first 52 bits of the id's md5; a rerun draws the same."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: shares of all words by weight, none above MOST_COPIES times its source.

    Sources in the order of (limit / weight) are full as long as the level of the others is above
    their own; the rest share what is left by weight.  This is where resharing the excess ends.
    Works on one row per source; the sizes are summed before that, on all tasks.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighted = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))).withColumn(
        "limit", MOST_COPIES * F.col("source_size")
    )
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    full = weighted.withColumn("full", F.col("limit") / F.col("weight") < level)
    held = lambda c, yes: F.coalesce(F.sum(F.when(F.col("full") == yes, F.col(c))).over(everything), F.lit(0))
    share = (F.sum("source_size").over(everything) - held("limit", True)) / held("weight", False)
    return full.select(
        "source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share * F.col("weight")).alias("target")
    )


def with_copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and copies.

    Null text has size 0, a null source is a source, a null id draws as the word null.  Repeated rows
    draw alike.  A source without words has target 0 and no copies.  An empty table stays empty.
    Columns of these four names in ``docs`` are replaced.

    The table of sources is written first, so that the planner knows its real size: a small one is
    sent to every task, a large one is joined by shuffle with skew splitting.
    """
    added = ("size", "source_size", "target", "copies", "mix_source")
    docs = docs.drop(*added)
    targets = materialise(
        source_targets(docs.select("source", n_words(F.col("text")).alias("size")))
    ).withColumnRenamed("source", "mix_source")
    joined = docs.withColumn("size", n_words(F.col("text"))).join(targets, F.col("source").eqNullSafe(F.col("mix_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", copies).drop("mix_source")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixture itself: every document as often as its copies say, with the columns of ``docs``, whatever their names."""
    held = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    mixed = with_copies(held, seed).where(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM sums
), levels AS (
  SELECT *, most / weight < ((sum(source_size) OVER ())::BIGINT - coalesce((sum(most) OVER before)::BIGINT, 0))
                            / ((sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER before)::BIGINT, 0)) AS is_full
  FROM weighted
  WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), totals AS (
  SELECT (sum(source_size)::BIGINT - coalesce(sum(most) FILTER (is_full), 0)::BIGINT)
         / (sum(weight) FILTER (NOT is_full))::BIGINT AS share FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE share * weight END AS target FROM levels, totals
), rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""
