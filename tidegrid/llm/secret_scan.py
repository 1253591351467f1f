"""Secret scans: fixed patterns, and strings that look random under character Markov models.

Method: two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, give a log-likelihood ratio for every long unbroken string.  Both are trained from labelled
samples: the strings of keys that the fixed patterns find in the corpus and strings drawn from the
alphabets of keys are random; every other word of the corpus is ordinary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm import words

# The base patterns, in the order in which kinds are listed, and what a match must have.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")
# a run of hex digits is looked for only where one is long enough; the runs found are the same
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)
_STRING = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_KEYWORDS = ("passw", "secret", "token", "api")

#: Alphabets of drawn keys, strings drawn from each and their length.
ALPHABETS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
DRAWN, DRAWN_LENGTH, SEED = 400, 40, 11
#: A string counts as random from this mean log-likelihood ratio a character on, if it has a digit.
MIN_RATIO = 1.5
#: States: printable ASCII, any other byte, and the edge of a string.
STATES, EDGE = 97, 96
_STATE = np.full(256, 95, np.int64)
_STATE[0x20:0x7F] = np.arange(95)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns, in code points."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def _pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Transition counts of the strings data[start:end], with an edge before and after each."""
    state = _STATE[data]
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside)[:-1] > 0
    opens = np.zeros(len(data), bool)
    opens[start] = True
    before = np.concatenate([[EDGE], state[:-1]])
    before[opens] = EDGE
    if not len(start):
        return np.zeros(STATES * STATES, np.int64)
    pairs = np.bincount(before[inside] * STATES + state[inside], minlength=STATES * STATES)
    closes = np.bincount(state[end - 1], minlength=STATES)
    pairs.reshape(STATES, STATES)[:, EDGE] += closes
    return pairs


def _string_pairs(strings: list[str]) -> np.ndarray:
    if not strings:
        return np.zeros(STATES * STATES, np.int64)
    ends = np.cumsum([len(s) for s in strings])
    data = np.frombuffer("".join(strings).encode("ascii"), np.uint8)
    return _pairs(data, np.concatenate([[0], ends[:-1]]), ends)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of a partition: key strings as random, other words as ordinary."""
    random, ordinary = (np.zeros(STATES * STATES, np.int64) for _ in range(2))
    for batch in batches:
        for part in words.chunks(batch, "text"):
            data, offsets = words.text_bytes(part.column("text"))
            found = words.Words(data, offsets)
            if len(found.start):
                ordinary += _pairs(data, found.start, found.end)
            for text in part.column("text").to_pylist():
                spans = base_spans(text) if text else []
                if not spans:
                    continue
                keys = [text[a:b] for a, k, b in spans if k != 0]
                keys += [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN and any(c.isdigit() for c in m[2])]
                random += _string_pairs(keys)
                # what a span covers is not ordinary
                end = 0
                for a, _, b in spans:
                    if b > end:
                        piece = np.frombuffer(text[max(a, end) : b].encode(), np.uint8)
                        inner = words.Words(piece, np.array([0, len(piece)]))
                        ordinary -= _pairs(piece, inner.start, inner.end)
                        end = b
    for label, counts in ((1, random), (0, ordinary)):
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), label)), pa.array(at), pa.array(counts[at])], ["label", "pair", "n"]
        )


class Markov:
    """Log-likelihood ratio of a string: random against ordinary, over its transitions."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        drawn = np.random.default_rng(SEED)
        for alphabet in ALPHABETS:
            letters = np.array(list(alphabet))
            random = random + _string_pairs(["".join(drawn.choice(letters, DRAWN_LENGTH)) for _ in range(DRAWN)])
        self.ratio = self._log(random) - self._log(ordinary)

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        table = np.maximum(counts.reshape(STATES, STATES), 0) + 0.5
        return np.log(table / table.sum(axis=1, keepdims=True))

    def mean(self, string: str) -> float:
        state = _STATE[np.frombuffer(string.encode("ascii"), np.uint8)]
        return float(self.ratio[state[:-1], state[1:]].mean())


def train(docs: DataFrame) -> Markov:
    """The two models from all rows of ``docs``; what is collected are two tables of 97 x 97 counts."""
    sums = docs.select("text").mapInArrow(_count, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, STATES * STATES), np.int64)
    for label, pair, n in sums.collect():
        counts[label, pair] = n
    return Markov(counts[1], counts[0])


def all_spans(text: str, model: Markov) -> list[tuple[int, int, int]]:
    """The base spans, and the random-looking strings that none of them touches."""
    found = base_spans(text)
    more = []
    for m in _STRING.finditer(text):
        a, b = m.span()
        if not any(c.isdigit() for c in m[0]) or any(s < b and a < e for s, _, e in found):
            continue
        if model.mean(m[0]) >= MIN_RATIO:
            more.append((a, 3, b))
    return sorted(found + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, redacted string"


def _redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each stretch that spans cover replaced by the name of the first kind there."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: Markov, redact: bool = False) -> DataFrame:
    """Spans of secrets of every row of ``docs`` (doc_id, text; others are ignored), and its text without them.

    Null text counts as empty: no spans.  Repeated rows and repeated or null ids keep their rows.
    Spans of one kind do not overlap; equal starts are in the order of KINDS.  An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    spans = all_spans(text or "", model)
                    base = [s for s in spans if s[1] < 3]
                    kinds = [s[1] for s in base]
                    rows.append(
                        (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))
                        + ((_redact(text, spans) if redact else None),)
                    )
                kinds = [pa.int64()] * 3 + [pa.string()] * 3
                arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *arrays],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
