"""Words and shingles of whole texts as 64-bit hashes, computed over the bytes of Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D; these bytes never occur inside a
longer UTF-8 character, so working on bytes and on characters gives the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at a time (a longer text is a chunk of its own).
CHUNK_BYTES = 2 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_ALL_BITS = (1 << 64) - 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null reads as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Start and end bytes of the words of consecutive texts; ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        inside = ~IS_SPACE[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        edges = offsets[offsets < len(data)]
        before[edges] = False
        opens = inside & ~before[:-1]
        # a word ends where the next byte is no word byte or belongs to another text
        follows = after[1:].copy()
        inner = offsets[(offsets > 0) & (offsets <= len(data))]
        follows[inner - 1] = False
        closes = inside & ~follows
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """One 64-bit number a word: its polynomial in an odd base, scrambled."""
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start])


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words and the offsets of each text's; a shorter text is one run."""
    w, n, first = words.hashes(), words.counts(), words.first
    total = len(w)
    runs = np.zeros(total, np.uint64)
    factor = 1
    for j in range(size):
        runs[: max(0, total - j)] += w[j:] * np.uint64(factor)
        factor = factor * _STEP & _ALL_BITS
    runs = mixed(runs)
    at = np.arange(total) - np.repeat(first[:-1], n)
    keep = at <= np.repeat(n - size, n)
    for i in np.flatnonzero((n > 0) & (n < size)):
        whole, factor = int(n[i]), 1
        for x in w[first[i] : first[i + 1]].tolist():
            whole += x * factor
            factor = factor * _STEP & _ALL_BITS
        runs[first[i]] = mixed(np.array([whole & _ALL_BITS], np.uint64))[0]
        keep[first[i]] = True
    counts = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    return runs[keep], np.concatenate([[0], np.cumsum(counts)])
