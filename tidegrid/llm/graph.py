"""Connected components of a table of edges by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegrid.sources.tables import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of all nodes with an edge (u, v).

    In each round every node points to the one of itself and its neighbours that has most of them (ties by a hash of
    this round), and edges are redrawn between the nodes pointed to.  Stars and dense groups fall together at once,
    long paths by a constant share in each round; the last node of an order is never pointed to, so rounds end.
    Each round is written to the shared folder, which cuts the lineage and survives lost executors.  A
    hot node's neighbours are reduced per task before they move, and joins of plain tables split its rows.  Null ends
    and loops are ignored.
    """
    ordered = lambda u, v: [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]
    current = materialise(edges.where("u <> v").select(*ordered("u", "v")).distinct())
    steps = []
    while not current.isEmpty():
        turn = len(steps)
        way = lambda x, y: current.select(F.col(x).alias("node"), F.col(y).alias("other"))  # noqa: B023, E731
        seen = way("u", "v").union(way("v", "u")).union(way("u", "u")).union(way("v", "v"))
        degrees = materialise(seen.groupBy(F.col("node").alias("known")).agg(F.count(F.lit(1)).alias("degree")))
        order = F.struct((-F.col("degree")).alias("d"), F.xxhash64("other", F.lit(turn)).alias("h"), F.col("other").alias("to"))
        chosen = seen.join(degrees, F.col("other") == F.col("known")).groupBy("node").agg(F.min(order).alias("first"))
        step = materialise(chosen.select("node", F.col("first.to").alias("to")))
        steps.append(step)
        left = step.select(F.col("node").alias("u"), F.col("to").alias("a"))
        right = step.select(F.col("node").alias("v"), F.col("to").alias("b"))
        current = materialise(current.join(left, "u").join(right, "v").where("a <> b").select(*ordered("a", "b")).distinct())
    if not steps:
        return current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = steps[-1].withColumnRenamed("to", "root")
    for step in reversed(steps[:-1]):
        later = roots.withColumnRenamed("node", "passed")
        roots = step.join(later, F.col("to") == F.col("passed"), "left").select("node", F.coalesce("root", "to").alias("root"))
    roots = materialise(roots)
    least = roots.groupBy(F.col("root").alias("whole")).agg(F.min("node").alias("label"))
    return roots.join(least, F.col("root") == F.col("whole")).select("node", "label")
