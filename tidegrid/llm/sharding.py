"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Method: a ring of cells carries the virtual nodes of every shard; a document hashes to a cell and
belongs to the next virtual node clockwise.  A shard takes documents up to its bound; those that find
it full go on clockwise to the next virtual node of a shard with room.

Spark counts documents per cell, ranks them inside their cell and looks their rank up; the walk
around the ring works on one number per cell, and the number of cells is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.llm.folds import unused_names
from tidegrid.sources.tables import materialise

#: Cells of the ring, sub-cells of a cell (the unit that one task ranks), virtual nodes of a shard.
CELLS, PARTS, NODES = 4096, 16, 64
SEGMENTS = "array<struct<cell:int,segments:array<struct<lo:bigint,hi:bigint,shard:int,base:bigint>>>>"


def ring(shards: int, nodes: int = NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise."""
    placed = []
    for shard in range(shards):
        for node in range(nodes):
            digest = hashlib.md5(f"shard {shard} node {node}".encode()).digest()
            placed.append((int.from_bytes(digest[:8], "big") % cells, digest, shard))
    return [(cell, shard) for cell, _, shard in sorted(placed)]


def bounds(demand: list[int], slack: float) -> list[int]:
    """The most documents of each shard.  Without slack they add up to all: counts differ by one at most."""
    total, shards = sum(demand), len(demand)
    if slack > 0:
        return [math.ceil((1 + slack) * total / shards)] * shards
    whole, rest = divmod(total, shards)
    more = set(sorted(range(shards), key=lambda s: (-demand[s], s))[:rest])
    return [whole + (s in more) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, nodes: int = NODES, cells: int = CELLS, slack: float = 0.0):
    """[(cell, first rank, end rank, shard, first slot)]: which ranks of a cell go to which shard.

    In each round every shard takes what has come to it, in ring order, up to its bound; the rest goes on
    clockwise.  A round with a rest fills a shard, so there are at most shards + 1 rounds.
    """
    around = ring(shards, nodes, cells)
    node_of, at = [], 0
    for cell in range(cells):
        while at < len(around) and around[at][0] < cell:
            at += 1
        node_of.append(at % len(around))
    arriving = [(node_of[cell], cell, 0, n) for cell, n in sorted(counts.items()) if n]
    demand = [0] * shards
    for node, _, lo, hi in arriving:
        demand[around[node][1]] += hi - lo
    most, held, out = bounds(demand, slack), [0] * shards, []
    while arriving:
        left = []
        for node, cell, lo, hi in sorted(arriving):
            shard = around[node][1]
            taken = min(hi - lo, most[shard] - held[shard])
            if taken:
                out.append((cell, lo, lo + taken, shard, held[shard]))
                held[shard] += taken
            if lo + taken < hi:
                left.append((node, cell, lo + taken, hi))
        # from each node the next one, clockwise, whose shard has room
        onward, last = [0] * len(around), None
        for node in reversed(range(2 * len(around))):
            onward[node % len(around)] = last if last is not None else 0
            if held[around[node % len(around)][1]] < most[around[node % len(around)][1]]:
                last = node % len(around)
        arriving = [(onward[node], cell, lo, hi) for node, cell, lo, hi in left]
    return out


def with_shards(docs: DataFrame, shards: int, slack: float = 0.0, nodes: int = NODES, cells: int = CELLS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with shard (int) and slot (long, gapless from 0 in each shard).

    Without slack the counts of two shards differ by one at most; with slack a shard holds at most
    (1 + slack) times the mean.  A null id is placed by its text, null text is like no text.  Rows that
    agree in id and text are interchangeable.  An empty table stays empty.  Columns named shard or
    slot in ``docs`` are replaced; all others stay, whatever their names.

    The collected and the sent table have at most ``cells`` and ``cells * PARTS`` rows, at any size.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    cell, part, order, n, before, segs, row, rank, mine = unused_names(
        docs, *("ring_cell ring_part ring_order ring_n ring_before ring_segments ring_row ring_rank ring_mine".split())
    )
    place = F.coalesce(F.xxhash64("doc_id"), F.lit(0))
    place = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).otherwise(place)
    keyed = docs.select(
        *columns,
        F.pmod(place, F.lit(cells)).cast("int").alias(cell),
        F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(PARTS)).cast("int").alias(part),
        F.xxhash64("doc_id", "text").alias(order),
    )
    parts = materialise(keyed.groupBy(cell, part).agg(F.count(F.lit(1)).alias(n)))
    counts = {r[0]: r[1] for r in parts.groupBy(cell).agg(F.sum(n)).collect()}
    by_cell: dict[int, list] = {}
    for held, lo, hi, shard, base in walk(counts, shards, nodes, cells, slack):
        by_cell.setdefault(held, []).append({"lo": lo, "hi": hi, "shard": shard, "base": base})
    literal = json.dumps([{"cell": c, "segments": s} for c, s in by_cell.items()])
    segments = spark.range(1).select(F.inline(F.from_json(F.lit(literal), SEGMENTS))).withColumnsRenamed({"cell": f"{cell}_", "segments": segs})
    earlier = Window.partitionBy(cell).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    table = parts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    table = table.join(segments, F.col(cell) == F.col(f"{cell}_")).drop(f"{cell}_")
    inside = Window.partitionBy(cell, part).orderBy(order, "doc_id")
    ranked = keyed.withColumn(row, F.row_number().over(inside))
    found = ranked.join(F.broadcast(table), [cell, part]).withColumn(rank, F.col(before) + F.col(row) - 1)
    held = F.filter(segs, lambda s: (F.col(rank) >= s["lo"]) & (F.col(rank) < s["hi"]))[0]
    return found.withColumn(mine, held).select(
        *columns,
        F.col(f"{mine}.shard").alias("shard"),
        (F.col(f"{mine}.base") + F.col(rank) - F.col(f"{mine}.lo")).alias("slot"),
    )
