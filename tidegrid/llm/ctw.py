"""Language-model scores by context-tree weighting over bytes.

Method: a byte is eight binary decisions; each decision has a tree of contexts of 0 to DEPTH bytes before
it, every node of which keeps a Krichevsky-Trofimov estimate.  The weighted probability of a node is
half its own estimate and half the product of its children's, so all depths are mixed by how well they
coded the training texts; -log2 of the result per byte is the code length.

The tree is data: nodes are rows, and the join of a text with its contexts is a shuffle.  Tasks reduce
the rows they scan to distinct (context, byte) keys and distinct words with training counts; the counts
are summed over all tasks; each key gets its probability from the tree; keys return to the rows that
asked for them.  No part of the model or the vocabulary is held whole anywhere, except for the tree's top
(contexts of 0 and 1 byte: at most 257 * 255 nodes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm import words
from tidegrid.llm.folds import remainder
from tidegrid.sources.tables import materialise

#: Bytes of the longest context.
DEPTH = 4
#: Bytes that UTF-8 never has: before a text, and after its last byte.
START, END = 0xFE, 0xFF
#: Smoothing of the word model.
ADDED = 0.1
#: Distinct keys that a task gathers before it folds them.
FOLD = 2_000_000
WORD, CONTEXT = 0, 1


def held_out(doc_id):
    return remainder(doc_id, 10) == 0


def context_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every byte of consecutive texts and of their ends, as 40-bit numbers, and each text's first.

    From the highest byte on: the byte before, the one before that, ..., the coded byte itself.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n) * (DEPTH + 1) + DEPTH
    padded = np.full(len(data) + n * (DEPTH + 1), START, np.uint8)
    padded[np.arange(len(data)) + np.repeat(starts - offsets[:-1], sizes)] = data
    padded[starts + sizes] = END
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.arange(first[-1]) + np.repeat(starts - first[:-1], sizes + 1)
    keys = padded[at].astype(np.int64)
    for d in range(1, DEPTH + 1):
        keys |= padded[at - d].astype(np.int64) << (8 * (DEPTH + 1 - d))
    return keys, first


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case (even, so that a flag has room), and each text's first."""
    found = words.Words(data, offsets, lower=True)
    return (found.hashes() & ~np.uint64(1)).view(np.int64), found.first


def _fold(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    together, at = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
    return [together], [np.bincount(at, np.concatenate([*counts, np.zeros(0)]), len(together))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of a partition with how often training texts have them."""
    block = TaskContext.get().partitionId()
    held = {kind: ([], []) for kind in (WORD, CONTEXT)}
    for batch in batches:
        for part in words.chunks(batch, "text"):
            data, offsets = words.text_bytes(part.column("text"))
            train = part.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            for kind, (keys, first) in ((WORD, word_keys(data, offsets)), (CONTEXT, context_keys(data, offsets))):
                flagged, n = np.unique((keys << 1 if kind == CONTEXT else keys) | np.repeat(train, np.diff(first)), return_counts=True)
                plain = flagged >> 1 if kind == CONTEXT else flagged & ~np.int64(1)
                held[kind][0].append(plain)
                held[kind][1].append(n * (flagged & 1))
                if sum(map(len, held[kind][0])) > FOLD:
                    held[kind] = _fold(*held[kind])
    for kind, parts in held.items():
        (keys,), (n,) = _fold(*parts)
        for a in range(0, len(keys), 100_000):
            k = keys[a : a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n[a : a + 100_000].astype(np.int64)), pa.array(np.full(len(k), block, np.int32))],
                ["kind", "key", "n", "block"],
            )


def _log_gamma_half(n: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift) for counts n of any size, by Stirling's series above a few steps of recursion."""
    x = n + shift
    steps = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        steps = np.where(small, steps + np.log(np.where(small, x, 1)), steps)
        x = np.where(small, x + 1, x)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - steps


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return _log_gamma_half(n0, 0.5) + _log_gamma_half(n1, 0.5) - np.log(np.pi) - _log_gamma_half(n0 + n1, 1.0)


def _nodes(context: np.ndarray, prefix: np.ndarray, bit: np.ndarray, n: np.ndarray):
    """The node of each row, the first row of each node, and the nodes' counts of zeros and ones."""
    _, first, at = np.unique(context << 8 | prefix, return_index=True, return_inverse=True)
    ones = np.bincount(at, n * bit, len(first))
    return at, first, np.bincount(at, n, len(first)) - ones, ones


def _mixed(p: np.ndarray, own: np.ndarray, rest: np.ndarray, zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The next decision's probability at a node from its deeper neighbour's, weighted by what each has coded."""
    odds = np.exp(np.clip(own - rest, -700, 700))
    return (odds * (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1) + p) / (odds + 1)


class Top:
    """The nodes of contexts of one byte and none, by (byte, bit prefix) and by bit prefix."""

    def __init__(self, rows: list[tuple]):
        self.zeros, self.ones, rest = (np.zeros((2, 256, 256)) for _ in range(3))
        for byte, node, zeros, ones, below in rows:
            self.zeros[1, byte, node], self.ones[1, byte, node], rest[1, byte, node] = zeros, ones, below
        self.zeros[0, 0], self.ones[0, 0] = self.zeros[1].sum(0), self.ones[1].sum(0)
        self.own = log_estimate(self.zeros, self.ones)
        rest[0, 0] = (np.logaddexp(self.own[1], rest[1]) - np.log(2)).sum(0)
        self.rest = rest

    def probability(self, p: np.ndarray, byte: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        for depth, at in ((1, (byte, node)), (0, (np.zeros_like(byte), node))):
            p = _mixed(p, self.own[depth][at], self.rest[depth][at], self.zeros[depth][at], self.ones[depth][at], bit)
        return p


def _bits(keys: np.ndarray, n: np.ndarray):
    """For each of the eight decisions: its node number, bit, probability at depth 2, and the nodes of depth 2."""
    coded, context = keys & 0xFF, keys >> 8
    for j in range(8):
        node, bit = (1 << j) | (coded >> (8 - j)), (coded >> (7 - j)) & 1
        at, first, zeros, ones = _nodes(context, node, bit, n)
        p = (np.where(bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
        weighted = log_estimate(zeros, ones)
        for depth in range(DEPTH - 1, 1, -1):
            up, up_first, zeros, ones = _nodes(context >> (8 * (DEPTH - depth)), node, bit, n)
            own, rest = log_estimate(zeros, ones), np.bincount(up[first], weighted, len(up_first))
            p = _mixed(p, own[up], rest[up], zeros[up], ones[up], bit)
            weighted, first, at = np.logaddexp(own, rest) - np.log(2), up_first, up
        yield node, bit, p, (first, zeros, ones, weighted)


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the nodes of two bytes of context hand up, for all such contexts of a partition."""
    table = _gathered(batches)
    if table is None:
        return
    keys, n = table.column("key").to_numpy(), table.column("n").to_numpy().astype(float)
    for node, _, _, (first, zeros, ones, weighted) in _bits(keys, n):
        columns = [pa.array(keys[first] >> 32), pa.array(node[first]), pa.array(zeros), pa.array(ones), pa.array(weighted)]
        yield pa.RecordBatch.from_arrays(columns, ["byte", "node", "zeros", "ones", "below"])


def _probabilities(top: Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gathered(batches)
        if table is None:
            return
        keys, n = table.column("key").to_numpy(), table.column("n").to_numpy().astype(float)
        total = np.zeros(len(keys))
        for node, bit, p, _ in _bits(keys, n):
            total += np.log10(top.probability(p, keys >> 32, node, bit))
        blocks = table.column("blocks").combine_chunks()
        yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), pa.array(total), blocks], ["key", "value", "blocks"])

    return run


def _lookup(keys: np.ndarray, table_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(0)
    at = np.minimum(np.searchsorted(table_keys, keys), len(table_keys) - 1) if len(table_keys) else None
    if at is None or (table_keys[at] != keys).any():
        raise RuntimeError("the rows of a partition differ between two reads; write the input as a table first")
    return values[at]


def _scorer(words_n: int, known: int, ends: int):
    denominator = words_n + ends + ADDED * (known + (ends > 0) + 1)

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        tables = {}
        kinds, all_keys, all_values = (found.column(c).to_numpy() for c in ("kind", "key", "value"))
        for kind in (WORD, CONTEXT):
            keys, values = all_keys[kinds == kind], all_values[kinds == kind]
            order = np.argsort(keys)
            tables[kind] = keys[order], values[order]
        rows = []
        for batch in docs.to_batches():
            for part in words.chunks(batch, "text"):
                data, offsets = words.text_bytes(part.column("text"))
                n = len(offsets) - 1
                keys, first = word_keys(data, offsets)
                counts = _lookup(keys, *tables[WORD])
                owner = np.repeat(np.arange(n), np.diff(first))
                base = np.bincount(owner, np.log10((counts + ADDED) / denominator), n) + np.log10((ends + ADDED) / denominator)
                known_words = np.bincount(owner, counts > 0, n).astype(np.int64) + (ends > 0)
                n_words = np.diff(first)
                keys, first = context_keys(data, offsets)
                coded = np.bincount(np.repeat(np.arange(n), np.diff(first)), _lookup(keys, *tables[CONTEXT]), n)
                rows.append(
                    pa.RecordBatch.from_arrays(
                        [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(n_words + 1), pa.array(known_words)]
                        + [pa.array(np.full(n, words_n + ends)), pa.array(base), pa.array(coded), pa.array(np.diff(offsets))],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
                    )
                )
        return pa.Table.from_batches(rows)

    return score


SCHEMA = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
    "score double, n_bytes bigint"
)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Word-model and context-tree scores of every row of ``docs`` (doc_id, text; others are ignored).

    Both models learn from the rows that are not held out.  base_score is the word model's log10
    probability, score the context tree's of the bytes and the end of the text; code length in bits a byte is
    -score * log2(10) / (n_bytes + 1).  Null text counts as empty, a null id as held out; repeated rows count
    as often as they occur and score alike; an empty table gives an empty result.

    ``docs`` is read twice and must give the same partitions both times, as a table does; if it doesn't, the
    job stops.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    ends = texts.where("NOT held_out").count()
    seen = texts.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_count, "kind byte, key bigint, n bigint, block int")
    keys = materialise(seen.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks")))
    words_n, known = (
        keys.where((F.col("kind") == WORD) & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    )
    contexts = keys.where(F.col("kind") == CONTEXT).select("key", "n", "blocks")
    # a subtree below two bytes of context is one task's; a partition holds many of them
    subtree = F.shiftright("key", 24)
    branches = contexts.select("key", "n").repartition(subtree).mapInArrow(_branches, "byte bigint, node bigint, zeros double, ones double, below double")
    top = Top([tuple(r) for r in branches.groupBy("byte", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()])
    coded = contexts.repartition(subtree).mapInArrow(_probabilities(top), "key bigint, value double, blocks array<int>")
    counts = keys.where(F.col("kind") == WORD).select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value"), "blocks")
    asked = counts.union(coded.select(F.lit(CONTEXT).alias("kind"), "key", "value", "blocks"))
    asked = asked.select(F.explode("blocks").alias("block"), "kind", "key", "value")
    placed = texts.withColumn("block", F.spark_partition_id())
    return placed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_scorer(int(words_n), int(known), ends), SCHEMA)
