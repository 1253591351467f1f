"""Benchmark leaks by latent semantic retrieval, then subsequence and answer checks.

Method: benchmark texts are cut into passages and these dealt to groups; the SVD of a group's TF-IDF matrix gives a
latent space, with inverse document frequencies counted over all documents.  Windows of every document are
projected into each space and meet the passages whose cosine is high enough; a pair of window and passage is a leak if the
longest common subsequence of their words covers the passage, or covers much of it and holds
its answer terms (a paraphrase).

The SVD is one of the benchmark's passages, not of the corpus: the leading directions of a corpus
tell its languages apart, and what tells one passage from another lies outside of them.  A space has as many dimensions
as its group has passages, so a passage lies in it whole, however many others the benchmark has.

The benchmark is taken in blocks; each is searched for in one scan of all documents, in whose tasks
cosines and checks are computed where the text is.  Texts are never moved.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.llm import words
from tidegrid.sources.tables import materialise

#: Counters of document frequencies and the pieces in which they travel (the same at any size).
COUNTERS, PIECES = 1 << 20, 64
#: Passages that share a latent space, on average.
GROUP = 64
#: Words of a benchmark passage; passages in a block, on average.
PASSAGE, BLOCK = 64, 1000
#: Words of a segment, and the windows of a document as numbers of segments, each twice the one before; they begin
#: at every segment.
SEGMENT, WINDOWS = 8, (2, 4, 8)
#: Least cosine of a candidate; the share of a passage that a common subsequence covers for a copy and for a paraphrase;
#: the answer terms of a passage and the share of them that a paraphrase holds.
MIN_COSINE, COPY, PARAPHRASE, ANSWER_TERMS, ANSWER_SHARE = 0.4, 0.75, 0.5, 6, 0.8
#: Characters that count as space here.
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#%&$_~`"
#: Bytes of text whose word vectors are held at a time.
SCAN_BYTES = 1 << 18


#: The same as a table of bytes; none of them occurs inside a longer character.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[list(PUNCTUATION.encode())] = ord(" ")


def plain(text: Column) -> Column:
    """Lower case: with punctuation, which ``_hashed`` reads as space, what a copy may change at no cost."""
    return F.lower(F.coalesce(text, F.lit("")))


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = words.text_bytes(column)
    found = words.Words(SPACED[data], offsets, lower=True)
    return found.hashes().view(np.int64), found.first


def _counter(w: np.ndarray) -> np.ndarray:
    return (w.view(np.uint64) >> np.uint64(44)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each counter occurs, in pieces; the last row counts the documents."""
    counts, rows = np.zeros(COUNTERS, np.int32), 0
    for batch in batches:
        for part in words.chunks(batch, "text", SCAN_BYTES):
            w, first = _hashed(part.column("text"))
            counters = _counter(w)
            for a, b in zip(first[:-1], first[1:]):
                counts[counters[a:b]] += 1  # once for each counter of the text, however often it has it
            rows += part.num_rows
    blobs = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, PIECES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(blobs, pa.binary()), pa.array([rows] + [0] * (PIECES - 1))], ["piece", "blob", "rows"])


def _add_pieces(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // PIECES, np.int64)
    for blob in table.column("blob"):
        total += np.frombuffer(zlib.decompress(blob.as_py()), np.int32)
    rows = sum(table.column("rows").to_pylist())
    return pa.table({"piece": table.column("piece")[:1], "blob": [zlib.compress(total.tobytes(), 1)], "rows": pa.array([rows])})


def weights_of(df: np.ndarray, rows: int) -> np.ndarray:
    """Inverse document frequencies, above 0 for words of all documents too: a passage may itself be in most of them."""
    return np.log((1 + rows) / (1 + df) + 1).astype(np.float32)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The weight of each counter, from all rows of ``docs`` (text)."""
    pieces = docs.select("text").mapInArrow(_frequencies, "piece int, blob binary, rows bigint")
    found = sorted(pieces.groupBy("piece").applyInArrow(_add_pieces, "piece int, blob binary, rows bigint").collect())
    if not found:
        return np.ones(COUNTERS, np.float32)
    df = np.concatenate([np.frombuffer(zlib.decompress(blob), np.int64) for _, blob, _ in found])
    return weights_of(df, found[0][2])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, passage (its place in the item) and its words as hashes."""
    for batch in batches:
        w, first = _hashed(batch.column("text"))
        rows = []
        for item, a, b in zip(batch.column("item_id").to_pylist(), first[:-1], first[1:]):
            for place, start in enumerate(range(a, b, PASSAGE)):
                rows.append((item, place, w[start : min(start + PASSAGE, b)].tobytes()))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["item_id", "place", "words"])


def latent_space(word_lists: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, their vectors by weight and the passages' vectors, of length 1: the SVD of a group's TF-IDF matrix.

    All directions are kept, so cosines in the space are those of the whole vectors.
    """
    vocabulary, at = np.unique(np.concatenate(word_lists), return_inverse=True)
    row = np.repeat(np.arange(len(word_lists)), [len(w) for w in word_lists])
    x = np.zeros((len(word_lists), len(vocabulary)))
    np.add.at(x, (row, at), weights[_counter(vocabulary)][at])
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    value, left = np.linalg.eigh(x @ x.T)
    kept = value > 1e-9 * max(value.max(), 1e-30)
    turn = left[:, kept] / np.sqrt(value[kept])
    return vocabulary, weights[_counter(vocabulary)][:, None] * (x.T @ turn), x @ (x.T @ turn)


def _spaces(weights: np.ndarray):
    """The latent space of a group of passages, in one row."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item_id", "ascending"), ("place", "ascending"), ("words", "ascending")])
        word_lists = [np.frombuffer(b.as_py(), np.int64) for b in table.column("words")]
        parts = [x.astype(kind).tobytes() for x, kind in zip(latent_space(word_lists, weights), ("i8", "f4", "f4"))]
        columns = [table.column(c).to_pylist() for c in ("item_id", "place", "words")]
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary())
        names = ["items", "places", "words", "vocabulary", "space", "vectors"]
        return pa.table({name: pa.array([value], kind) for name, value, kind in zip(names, [*columns, *parts], kinds)})

    return run


SPACE = "items array<bigint>, places array<int>, words array<binary>, vocabulary binary, space binary, vectors binary"


@dataclasses.dataclass
class Block:
    """What a scan looks for: passages with their words, and by group their latent vectors and those of their words.

    ``vocabulary`` has each word once; ``cut`` says which ``uses`` are whose, rows of a group's space.
    """

    ids: list[tuple[int, int]]
    words: list[np.ndarray]
    vocabulary: np.ndarray
    cut: np.ndarray
    group: np.ndarray
    uses: np.ndarray
    spaces: list[np.ndarray]
    members: list[np.ndarray]
    vectors: list[np.ndarray]
    weights: np.ndarray

    def answer_terms(self, i: int) -> np.ndarray:
        """Where the rarest words of a passage are; they stand for its answer, for which the benchmark has no column."""
        word, at = np.unique(self.words[i], return_index=True)
        return at[np.argsort(-self.weights[_counter(word)], kind="stable")[:ANSWER_TERMS]]


def _block(rows, weights: np.ndarray) -> Block:
    """Of the rows of ``_spaces``."""
    ids, word_lists, known, spaces, members, vectors = [], [], [], [], [], []
    for r in rows:
        members.append(np.arange(len(ids), len(ids) + len(r["items"])))
        ids += zip(r["items"], r["places"])
        word_lists += [np.frombuffer(w, np.int64) for w in r["words"]]
        known.append(np.frombuffer(r["vocabulary"], np.int64))
        spaces.append(np.frombuffer(r["space"], np.float32).reshape(len(known[-1]), -1))
        vectors.append(np.frombuffer(r["vectors"], np.float32).reshape(len(members[-1]), -1))
    size = [len(k) for k in known]
    word, uses = np.concatenate(known), np.concatenate([np.arange(n) for n in size])
    order = np.argsort(word, kind="stable")
    vocabulary, first = np.unique(word[order], return_index=True)
    group = np.repeat(np.arange(len(size), dtype=np.int16), size)[order]
    return Block(ids, word_lists, vocabulary, np.append(first, len(word)), group, uses[order], spaces, members, vectors, weights)


def subsequence(equal: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences, from the table of which of their words agree."""
    equal = equal[equal.any(1)][:, equal.any(0)]
    row = np.zeros(equal.shape[1] + 1, np.int32)
    for same in equal:
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + same)
        row = np.maximum.accumulate(step)
    return int(row[-1])


def candidates(block: Block, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, text, passage) of windows and passages whose latent cosine is high enough.

    A window's length counts all its words, in the space or not, so a few words in common are not alike.  No cosine
    exceeds the share of the length that lies in the space: only windows whose share allows a candidate meet
    the passages.
    """
    n = np.diff(first)
    per_text = -(-n // SEGMENT)
    text = np.repeat(np.arange(len(n)), per_text)
    step = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = first[:-1][text] + step * SEGMENT
    segment = np.repeat(np.arange(len(start)), np.minimum(SEGMENT, first[1:][text] - start))
    weight = block.weights[_counter(w)]
    left = np.repeat(per_text, per_text) - step
    inside = {half: np.flatnonzero(left > half) for half in (width // 2 for width in WINDOWS)}

    def wider(sums: np.ndarray, half: int) -> np.ndarray:
        # a window that the text's end cuts is the same as a shorter one that begins there
        out = sums.copy()
        out[inside[half]] += sums[inside[half] + half]
        return out

    norms = {1: np.bincount(segment, weight.astype(float) ** 2, len(start))}
    for width in WINDOWS:
        norms[width] = wider(norms[width // 2], width // 2)
    at = np.minimum(np.searchsorted(block.vocabulary, w), len(block.vocabulary) - 1)
    known = np.flatnonzero((block.vocabulary[at] == w) & (weight > 0))
    # each known word with all groups that it is in
    low, many = block.cut[at[known]], block.cut[at[known] + 1] - block.cut[at[known]]
    use = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    known = np.repeat(known, many)
    order = np.argsort(block.group[use], kind="stable")
    edges = np.searchsorted(block.group[use][order], np.arange(len(block.spaces) + 1))
    out = []
    for g, (space, vectors, members) in enumerate(zip(block.spaces, block.vectors, block.members)):
        mine = order[edges[g] : edges[g + 1]]
        if not len(mine):
            continue
        owner, row = segment[known[mine]], block.uses[use[mine]]
        fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        z = np.zeros((len(start), space.shape[1]), np.float32)
        for k in range(SEGMENT):  # far faster than a sum by runs
            some = np.flatnonzero(place == k)
            z[owner[some]] += space[row[some]]
        for width in WINDOWS:
            z, norm = wider(z, width // 2), norms[width]
            close = np.flatnonzero((norm > 0) & (np.einsum("ij,ij->i", z, z) >= MIN_COSINE**2 * norm))
            for a in range(0, len(close), 4096):
                some = close[a : a + 4096]
                cosine = z[some] @ vectors.T / np.sqrt(np.maximum(norm[some], 1e-12))[:, None]
                row, passage = np.nonzero(cosine >= MIN_COSINE)
                end = np.minimum(start[some[row]] + width * SEGMENT, first[1:][text[some[row]]])
                out.append(np.stack([start[some[row]], end, text[some[row]], members[passage]]))
    return tuple(np.concatenate(out, 1)) if out else tuple(np.zeros((4, 0), np.int64))


def _leaks(block: Block):
    answers = [block.answer_terms(i) for i in range(len(block.ids))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text", SCAN_BYTES):
                w, first = _hashed(part.column("text"))
                best: dict[tuple[int, int], tuple] = {}
                reach: dict[tuple[int, int], list] = {}
                if len(w):
                    # windows of a text that meet the same passage are checked together where they touch
                    found = np.stack(candidates(block, w, first), 1)
                    for a, b, text, passage in found[np.lexsort((found[:, 0], found[:, 3], found[:, 2]))].tolist():
                        spans = reach.setdefault((text, passage), [])
                        margin = len(block.words[passage])
                        low, high = max(first[text], a - margin), min(first[text + 1], b + margin)
                        if spans and low <= spans[-1][1] and high - spans[-1][0] <= 8 * PASSAGE:
                            spans[-1][1] = max(spans[-1][1], high)
                        else:
                            spans.append([low, high])
                for (text, passage), spans in reach.items():
                    mine = block.words[passage]
                    for low, high in spans:
                        equal = mine[:, None] == w[None, low:high]
                        # no subsequence is longer than the words that occur at all
                        if equal.any(1).mean() < PARAPHRASE:
                            continue
                        share = subsequence(equal) / len(mine)
                        answer = float(equal[answers[passage]].any(1).mean())
                        if share >= COPY or (share >= PARAPHRASE and answer >= ANSWER_SHARE):
                            item = (text, block.ids[passage][0])
                            best[item] = max(best.get(item, (0.0,)), (share, answer, block.ids[passage][1], int(low - first[text]), int(high - first[text])))
                if best:
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[t], item, *found) for (t, item), found in best.items()]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                        ["doc_id", "item_id", "covered", "answer", "place", "first_word", "end_word"],
                    )

    return run


LEAK = "doc_id bigint, item_id bigint, covered double, answer double, place int, first_word bigint, end_word bigint"


def blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks, each of which holds about BLOCK passages and the latent spaces of their groups."""
    weights = inverse_frequencies(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain(F.col("text")).alias("text"))
    cut = items.mapInArrow(_passages, "item_id bigint, place int, words binary").distinct()
    passages = materialise(cut)
    n_groups = max(1, -(-passages.count() // GROUP))
    group = F.pmod(F.xxhash64("item_id", "place", "words"), F.lit(n_groups))
    spaces = materialise(passages.groupBy(group.alias("of")).applyInArrow(_spaces(weights), SPACE).withColumn("at", F.monotonically_increasing_id()))
    per_block = max(1, BLOCK // GROUP)
    keys = sorted(r["at"] for r in spaces.select("at").collect())
    for i in range(0, len(keys), per_block):
        yield _block(spaces.where(F.col("at").between(keys[i], keys[i : i + per_block][-1])).orderBy("at").collect(), weights)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, covered (share of the passage's words in
    a common subsequence), answer (share of its answer terms), place, first_word and end_word of the region.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored.  Null and empty
    texts, items without words are found nowhere.  Repeated rows are found alike, each with its row; a null
    id stays null.  An empty table on either side gives an empty result.  Texts are searched whole.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain(F.col("text")).alias("text"))
    found = None
    for block in blocks(texts, benchmark):
        one = texts.mapInArrow(_leaks(block), LEAK)
        found = one if found is None else found.union(one)
    if found is None:
        return texts.where("false").selectExpr("doc_id", "doc_id AS item_id", "0D AS covered", "0D AS answer", "0 AS place", "0L AS first_word", "0L AS end_word")
    # an item of several passages may be found in several blocks
    row = F.struct("covered", "answer", "place", "first_word", "end_word")
    best = found.groupBy("doc_id", "item_id").agg(F.max(row).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item was found; rows without an id are judged by no one and stay.

    Only ids of leaking documents meet the rows; they are written first, so the planner knows their size.
    """
    leaking = materialise(leaks(docs, benchmark).where("doc_id IS NOT NULL").select("doc_id").distinct())
    return docs.join(leaking, "doc_id", "left_anti").select(*docs.columns)
