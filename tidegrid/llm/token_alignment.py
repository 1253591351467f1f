"""Alignment of the tokens that two tokenizers cut one text into, and how often their ids are linked corpus-wide.

Method: both token lists are arrays of end offsets.  As long as they cut alike, the arrays are equal at a constant shift of
the index; exponential probing compares ever longer stretches at that shift and jumps over what is equal.  Where
they differ, the two are merged token by token until both end at one offset again; the shift changes there.

Links of id pairs are counted in each block of texts first.  Blocks keep their documents as (pair, times) lists; each
distinct pair of a block meets the corpus-wide counts once, and the counts come back to the block.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm import words
from tidegrid.llm.token_counts import PRINTABLE, SPLIT, _as_ranks
from tidegrid.sources.tables import materialise

#: Bytes of text of a block (a longer text is a block of its own), and ends that a probe compares at first.
BLOCK_BYTES, FIRST_PROBE = 1 << 20, 8
#: What the piece tokenizer writes for a space.
SPACE = "▁"

DOCUMENT = [
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
]
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


class ByteTokens:
    """A byte-level BPE file: ids of texts, and the bytes of each id.  Special strings in a text are plain text.

    Texts of Latin letters go through the same merges in tiktoken; others through the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        others = (b for b in range(256) if b not in PRINTABLE)
        letters = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        ranks, self.fast = _as_ranks(path), None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = [i for i, x in enumerate(texts) if self.fast is None or (not x.isascii() and max(x) >= "ɐ")]
        found = dict(zip(slow, (e.ids for e in self.library.encode_batch([texts[i] for i in slow], add_special_tokens=False))))
        return [found[i] if i in found else self.fast.encode_ordinary(x) for i, x in enumerate(texts)]


class PieceTokens:
    """A sentence-piece model: ids of texts (to which it adds a space in front), and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(self.library.id_to_piece(i), self.library.is_byte(i)) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace(SPACE, " ").encode() for p, is_byte in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=4)
def tokens_of(path: str) -> ByteTokens | PieceTokens:
    return ByteTokens(path) if path.endswith(".json") else PieceTokens(path)


class Alignment:
    """Groups and links of two arrays of end offsets that end at the same offset.

    opens_a and opens_b mark the tokens that open a group; link_a and link_b are the places of linked tokens.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        ends_a, ends_b = a.tolist(), b.tolist()
        raw_a, raw_b, width = a.tobytes(), b.tobytes(), a.itemsize
        n, i, j = len(ends_a), 0, 0
        stretches: list[tuple[int, int, int]] = []
        opens_a, opens_b = np.ones(len(a), bool), np.ones(len(b), bool)
        inner_a, inner_b, link_a, link_b = [], [], [], []
        linked_a, linked_b, jumped = link_a.append, link_b.append, stretches.append
        while i < n:
            if ends_a[i] == ends_b[j]:
                # u and v: bytes of the ends compared next; a probe over the arrays' ends is equal if both end there
                u, v, probe = (i + 1) * width, (j + 1) * width, FIRST_PROBE * width
                while u < len(raw_a) and raw_a[u : u + probe] == raw_b[v : v + probe]:
                    u, v, probe = u + probe, v + probe, 2 * probe
                while probe > width:  # the end of the stretch is inside: halve
                    probe >>= 1
                    if u < len(raw_a) and raw_a[u : u + probe] == raw_b[v : v + probe]:
                        u, v = u + probe, v + probe
                k = min(u // width, n) - i
                jumped((i, j, k))
                i, j = i + k, j + k
                if i == n:
                    break
            # an irregular group: merged until both end alike
            x, y = ends_a[i], ends_b[j]
            linked_a(i)
            linked_b(j)
            while x != y:
                if x < y:
                    i += 1
                    x = ends_a[i]
                    inner_a.append(i)
                else:
                    j += 1
                    y = ends_b[j]
                    inner_b.append(j)
                linked_a(i)
                linked_b(j)
            i, j = i + 1, j + 1
        opens_a[inner_a] = False
        opens_b[inner_b] = False
        self.opens_a, self.opens_b, self.jumps = opens_a, opens_b, len(stretches)
        at, to, size = np.array(stretches, np.int64).reshape(-1, 3).T
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.link_a = np.concatenate([np.repeat(at, size) + inside, np.array(link_a, np.int64)])
        self.link_b = np.concatenate([np.repeat(to, size) + inside, np.array(link_b, np.int64)])


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _groups(ids_a: np.ndarray, ids_b: np.ndarray, aligned: Alignment, of_doc: np.ndarray) -> list[str]:
    """The groups of each document as text; ``of_doc`` is how many groups each has."""
    sides = []
    for ids, opens in ((ids_a, aligned.opens_a), (ids_b, aligned.opens_b)):
        starts = np.flatnonzero(opens)
        text = pc.cast(pa.array(ids), pa.string())
        sides.append(pc.binary_join(_lists(text, np.diff(np.concatenate([starts, [len(ids)]]))), ","))
    return pc.binary_join(_lists(pc.binary_join_element_wise(*sides, "|"), of_doc), ";").to_pylist()


def _aligner(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_a, tokens_b = tokens_of(path_a), tokens_of(path_b)
        size_a, size_b = (np.array([len(x) for x in t.bytes]) for t in (tokens_a, tokens_b))
        for batch in batches:
            for part in words.chunks(batch, "text", BLOCK_BYTES):
                texts = part.column("text").to_pylist()
                lists_a, lists_b = tokens_a.encode([f" {t}" for t in texts]), tokens_b.encode(texts)
                used = np.zeros(len(texts), bool)
                for i, (t, a, b) in enumerate(zip(texts, lists_a, lists_b)):
                    whole = f" {t}".encode()
                    used[i] = bool(t) and all(b"".join(map(k.bytes.__getitem__, ids)) == whole for k, ids in ((tokens_a, a), (tokens_b, b)))
                n_a, n_b = (np.array([len(x) if u else 0 for x, u in zip(ids, used)], np.int64) for ids in (lists_a, lists_b))
                ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x, u in zip(ids, used) if u)]) for ids in (lists_a, lists_b))
                del lists_a, lists_b
                aligned = Alignment(np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b]))
                doc = np.repeat(np.arange(len(texts)), n_a)
                n_groups = np.bincount(doc[aligned.opens_a], minlength=len(texts))
                pair, each, total = np.unique(ids_b[aligned.link_b] << 32 | ids_a[aligned.link_a], return_inverse=True, return_counts=True)
                own, times = np.unique(doc[aligned.link_a] * (len(pair) + 1) + each, return_counts=True)
                held = np.bincount(own // (len(pair) + 1), minlength=len(texts))
                digests = [hashlib.sha256(g.encode()).hexdigest() if u else "" for g, u in zip(_groups(ids_a, ids_b, aligned, n_groups), used)]
                columns = [
                    part.column("doc_id").cast(pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(n_groups),
                    pa.array(np.bincount(doc[aligned.link_a], minlength=len(texts))), pa.array(digests, pa.string()),
                    _lists(pa.array(own % (len(pair) + 1), pa.int32()), held), _lists(pa.array(times, pa.int32()), held),
                ]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema(DOCUMENT), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(pa.RecordBatch.from_arrays(columns, schema=pa.schema(DOCUMENT)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 65]), pa.array([sink.getvalue().to_pybytes()]), _lists(pa.array(pair), [len(pair)]), _lists(pa.array(total), [len(pair)])],
                    ["block", "documents", "pair", "times"],
                )

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RESULT.split(", ")]
    for batch in batches:
        for documents, found in zip(batch.column("documents"), batch.column("found")):
            docs = pa.ipc.open_stream(documents.as_py()).read_next_batch()
            answers = found.values
            pair, count, best = (np.zeros(0, np.int64) if answers is None else answers.field(k).to_numpy(zero_copy_only=False) for k in ("pair", "count", "best"))
            order = np.argsort(pair)
            count, best = count[order], best[order].astype(bool)
            at, times = (docs.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("pairs", "times"))
            doc = np.repeat(np.arange(docs.num_rows), np.diff(docs.column("pairs").offsets.to_numpy()))
            n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
            np.add.at(n_best, doc[best[at]], times[best[at]])
            np.add.at(count_sum, doc, count[at] * times)
            values = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
            yield pa.RecordBatch.from_arrays([values[k] if k in values else docs.column(k) for k in names], names)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Token counts, groups and links of every row of ``docs`` (doc_id, text; others are ignored), by two tokenizers.

    Texts that are null or empty, or whose joined bytes one of the tokenizers changes, have no tokens: zeros, and an empty
    groups_sha256.  Rows that repeat and null ids keep their rows and count as often as they occur; an empty table
    stays empty; long texts are encoded whole.  Of several A ids linked with a B id equally often, all are best.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = materialise(texts.mapInArrow(_aligner(path_a, path_b), "block bigint, documents binary, pair array<bigint>, times array<bigint>"))
    pairs = blocks.select("block", F.explode(F.arrays_zip("pair", "times")).alias("one")).select("block", "one.pair", "one.times")
    totals = materialise(pairs.groupBy("pair").agg(F.sum("times").alias("count")))
    most = totals.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("count").alias("most"))
    ranked = totals.join(most, F.shiftright(totals.pair, 32) == F.col("b")).select(F.col("pair").alias("known"), "count", (F.col("count") == F.col("most")).alias("best"))
    asked = blocks.select("block", F.explode("pair").alias("pair")).join(ranked, F.col("pair") == F.col("known"))
    # as many as a block has distinct pairs
    found = asked.groupBy(F.col("block").alias("home")).agg(F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    return blocks.select("block", "documents").join(found, F.col("block") == F.col("home"), "left").select("documents", "found").mapInArrow(_scores, RESULT)
