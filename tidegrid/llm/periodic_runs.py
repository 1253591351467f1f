"""Periodic runs of words in texts, by internal pattern matching.

Method: a text is cut into blocks of 1, 2, 4, ... words.  A run of period q and at least 4 q words holds a whole block
of the least such length that is not below q, and the block's nearest other occurrence, on one side at least,
lies exactly q words away.  So each block asks for its nearest occurrences in the windows of its own length on both sides;
a wavelet tree over the suffix array answers with range successor and predecessor; the distance, the step of the
progression of occurrences, is a candidate period.  Candidates are extended word by word, in dyadic steps, to both sides.

Many texts are worked on at a time: their suffixes are sorted together, the text first, so that texts never mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.llm import words

#: A run has at least so many words and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
WORD = r"[^\x20\x09-\x0D]+"


class Suffixes:
    """Suffix array of consecutive texts by doubling: one rank a word for blocks of 1, 2, 4, ... words.

    Equal ranks at a level are equal whole blocks of one text; the rank is where their group begins in the array.
    """

    def __init__(self, values: np.ndarray, first: np.ndarray):
        n = len(values)
        self.owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.start = np.repeat(first[:-1], np.diff(first))
        end = np.repeat(first[1:], np.diff(first))
        self.array = np.lexsort((values, self.owner))
        v, o = values[self.array], self.owner[self.array]
        opens = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])[:n]
        self.levels, self.sizes, length = [], [], 1
        rank = np.empty(n, np.int64)
        rank[self.array] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        while n:
            starts = np.flatnonzero(opens)
            size = np.diff(np.concatenate([starts, [n]]))
            many = np.repeat(size > 1, size)
            if not many.any():
                break
            by_slot = np.repeat(size, size)
            self.levels.append(rank.copy())
            whole = np.empty(n, np.int64)
            whole[self.array] = by_slot
            self.sizes.append(whole)
            slots = np.flatnonzero(many)
            at = self.array[slots]
            follows = at + length
            second = np.where(follows < end[at], rank[np.minimum(follows, n - 1)], -1)
            order = np.lexsort((second, rank[at]))
            at, second = at[order], second[order]
            self.array[slots] = at
            changed = np.concatenate([[True], (second[1:] != second[:-1]) | (rank[at][1:] != rank[at][:-1])])
            opens[slots] = changed
            rank[at] = slots[np.maximum.accumulate(np.where(changed, np.arange(len(slots)), 0))]
            length *= 2

    def ahead(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many words from u and v on are equal."""
        n, got = len(self.owner), np.zeros(len(u), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = u + got, v + got
            inside = b < n
            rank = self.levels[k]
            got += np.where(inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]), 1 << k, 0)
        return got

    def behind(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many words before u and v are equal."""
        got = np.zeros(len(u), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = u - got - (1 << k), v - got - (1 << k)
            rank = self.levels[k]
            got += np.where((a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)]), 1 << k, 0)
        return got


class WaveletTree:
    """Numbers of an array by their bits, highest first, kept as counts of zero bits."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(values.max(initial=0)).bit_length(), 1)
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            count = np.zeros(len(values) + 1, np.int64)
            np.cumsum(1 - bit, out=count[1:])
            self.zeros.append(count)
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers in each range lo:hi are less than x."""
        total = np.zeros(len(lo), np.int64)
        for b, count in zip(range(self.bits - 1, -1, -1), self.zeros):
            one, low, high = (x >> b) & 1 == 1, count[lo], count[hi]
            total += np.where(one, high - low, 0)
            lo, hi = np.where(one, count[-1] + lo - low, low), np.where(one, count[-1] + hi - high, high)
        return total

    def ranked(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with k lesser ones in each range lo:hi."""
        value = np.zeros(len(lo), np.int64)
        for b, count in zip(range(self.bits - 1, -1, -1), self.zeros):
            low, high = count[lo], count[hi]
            one = k >= high - low
            value += np.where(one, 1 << b, 0)
            k = np.where(one, k - (high - low), k)
            lo, hi = np.where(one, count[-1] + lo - low, low), np.where(one, count[-1] + hi - high, high)
        return value


def _least_occurrences(length: int) -> int:
    """How often a block of this length that a run gives a period to occurs in the run at least."""
    periods = range(length // 2 + 1, length + 1)
    return min((max(LEAST_WORDS, LEAST_TIMES * q) - length + 1) // q for q in periods) if length <= 64 else 2


def runs(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of consecutive texts, by start and period; ``values`` are the words as numbers."""
    sorted_ = Suffixes(values, first)
    place = np.arange(len(values)) - sorted_.start
    asked = []
    for k, (rank, size) in enumerate(zip(sorted_.levels, sorted_.sizes)):
        # what is not alone at a level has a whole block there
        at = np.flatnonzero((size >= _least_occurrences(1 << k)) & (place & ((1 << k) - 1) == 0))
        asked.append((np.full(len(at), 1 << k), at, rank[at], size[at]))
    none = np.zeros(0, np.int64)
    length, at, lo, size = (np.concatenate(c) for c in zip(*asked)) if asked else (none,) * 4
    if not len(at):
        return none, none, none
    tree = WaveletTree(place[sorted_.array])
    here, hi = place[at], lo + size
    rank = tree.below(lo, hi, here)
    found = []
    for step in (1, -1):
        there = (rank + step >= 0) & (rank + step < size)
        other = tree.ranked(lo[there], hi[there], rank[there] + step)
        period = np.abs(other - here[there])
        near = (period <= length[there]) & (2 * period > length[there])
        found.append((at[there][near] - (period[near] if step < 0 else 0), period[near]))
    u, period = (np.concatenate(c) for c in zip(*found))
    start = u - sorted_.behind(u, u + period)
    end = u + period + sorted_.ahead(u, u + period)
    keep = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # a stretch that has several periods has the least of them
    own = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, period = start[own], end[own], period[own]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch, "text"):
            found = words.Words(*words.text_bytes(part.column("text")))
            start, end, period = runs(found.hashes(), found.first)
            owner = np.searchsorted(found.first, start, "right") - 1
            counts = np.bincount(owner, minlength=part.num_rows) if len(start) else np.zeros(part.num_rows, np.int64)
            change = np.zeros(found.first[-1] + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            dropped = np.cumsum(change)[:-1] > 0
            collapsed = []
            for text, a, b, n in zip(part.column("text").to_pylist(), found.first[:-1], found.first[1:], counts):
                split = text.encode().split()
                kept = [w for w, gone in zip(split, dropped[a:b].tolist()) if not gone] if n else split
                collapsed.append(b" ".join(kept).decode())
            base = found.first[owner] if len(start) else start
            each = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(found.counts()), pa.ListArray.from_arrays(offsets, each), pa.array(collapsed)],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed (the text without
    repetitions: of each run the first period stays) of every row of ``docs`` (doc_id, text; others are ignored).

    A run is a stretch of words with least period q and at least max(6, 4 q) words that no word beside it extends.
    Null and empty texts have no words, no runs and an empty collapsed text.  Rows are judged one by one: repeated rows and
    null ids keep their rows, an empty table stays empty.  Words are joined by single spaces; texts are taken whole.
    Words are compared by 64-bit hashes.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_find, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first, null if there is none."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda a, r: a.isNull() | (r.length * a.period > a.length * r.period)
    return F.aggregate(found, none, lambda a, r: F.when(better(a, r), r).otherwise(a))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, a tenth of the texts (by the id's checksum) periodic from one of their words on.

    Such a text's words are joined by single spaces.  Rows without an id or without words stay as they are.
    """
    split = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.coalesce(h % 10 == 0, F.lit(False)).alias("planted"), F.floor(h / 10).cast("bigint").alias("g"))
    chosen = chosen.withColumn("w", F.when(F.col("planted"), split))
    chosen = chosen.withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("bigint"))).withColumn("a", F.expr("g % n"))
    chosen = chosen.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    places = F.sequence(F.lit(0).cast("bigint"), F.size("w").cast("bigint") - 1)
    source = F.transform(places, lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i))
    text = F.array_join(F.transform(source, lambda i: F.get("w", i.cast("int"))), " ")
    return chosen.select("doc_id", F.when(F.col("n").isNotNull(), text).otherwise(F.col("text")).alias("text"))
