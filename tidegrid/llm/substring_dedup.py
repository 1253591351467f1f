"""Removal of word passages that an earlier document has too, by level-wise doubling.

Method: windows of BASE words come first, and of them only the least of each longer window (its anchor), which is a
quarter of all.  Windows of WINDOW words are looked up only where their anchor is repeated between documents, and these
decide what is removed.  Of the repeated ones, a sparse set that both documents choose alike is extended to twice the
length, and again, until no candidate survives; this tells how long the passages are.

Texts lie in packs of a few MB.  A level sends each window of a pack once, with the least and greatest id that has it
there, to the bucket of its hash; two bits a window come back.  So what a bucket or pack holds is bounded,
however often a passage occurs, and whole copies leave before any window of WINDOW words of theirs is sent.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm import words
from tidegrid.sources.tables import materialise

BASE, WINDOW = 6, 13
#: Of so many windows in a row the least is extended.
SPREAD = 2 * WINDOW
#: Bytes of text of a pack (a longer text is a pack of its own), and words for each bucket.
PACK_BYTES, BUCKET_WORDS = 4 << 20, 1 << 20
#: A null id counts as later than all others.
LAST = 2**63 - 1
#: Above all hashes of windows but one, and the seed of the second hash.
NONE, SECOND = ~np.uint64(0), 0x5851F42D4C957F2D

ROW = "kind string, block bigint, at bigint, id bigint, h binary, c binary, lo binary, hi binary, pack binary"
ANSWER = "block bigint, at bigint, repeated binary, earlier binary, copies array<bigint>"
_ROW_NAMES = [part.split()[0] for part in ROW.split(", ")]
_ROW_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
_STATE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("longest", pa.int64())])
_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("longest", pa.int64())])


def _row(kind: str, block: int, **values) -> pa.RecordBatch:
    given = {"kind": kind, "block": block, **values}
    return pa.RecordBatch.from_arrays([pa.array([given.get(k)], t) for k, t in zip(_ROW_NAMES, _ROW_TYPES)], _ROW_NAMES)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(pack: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pack).read_next_batch()


class Windows:
    """Hashes of the word windows of consecutive texts, for any length."""

    def __init__(self, texts: pa.Array):
        found = words.Words(*words.text_bytes(texts))
        self.counts, self.owner, self.first = found.counts(), found.owner(), found.first
        self.value = found.hashes()
        self.total = len(self.value)
        self.left = np.repeat(self.first[1:], self.counts) - np.arange(self.total)  # words from here to the text's end
        self.up, self.down = words._power_tables(self.total + 1)
        self.sums: dict[int, np.ndarray] = {}

    def hashes(self, length: int, at: np.ndarray, seed: int = 0) -> np.ndarray:
        if seed not in self.sums:
            self.sums[seed] = np.zeros(self.total + 1, np.uint64)
            value = words.mixed(self.value ^ np.uint64(seed)) if seed else self.value
            np.cumsum(value * self.up[: self.total], out=self.sums[seed][1:])
        sums = self.sums[seed]
        return words.mixed((sums[at + length] - sums[at]) * self.down[at])

    def keys(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the windows that begin at the given words."""
        return self.hashes(length, at), (self.hashes(length, at, SECOND) >> np.uint64(32)).astype(np.uint32)

    def whole(self, length: int) -> np.ndarray:
        """Where a window of this length begins."""
        return np.flatnonzero(self.left >= length)

    def least(self, length: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash of the window at each word, the least of those at the ``spread`` words from it on, and the words
        whose window is the least of such a stretch (the anchors; of equal ones all)."""
        value = np.full(self.total + spread, NONE)
        inside = self.whole(length)
        value[inside] = self.hashes(length, inside)
        least = _sliding(np.minimum, value, spread)[: self.total]
        stretch = np.zeros(self.total + spread, np.uint64)
        full = self.whole(length + spread - 1)
        stretch[full + spread - 1] = least[full]
        # a window's hash is at least the least of any stretch over it
        over = _sliding(np.maximum, stretch, spread)[: self.total]
        value = value[: self.total]
        anchors = np.flatnonzero((over == value) & (self.left >= length) & (value > 0))
        return value, least, anchors


def _sliding(combine: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """combine over the ``width`` values from each place on, by doubling; the last width - 1 places are left out."""
    out, done = values, 1
    while 2 * done <= width:
        out = combine(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return combine(out[: len(out) - rest], out[rest:]) if rest else out


def _order(ids: pa.Array) -> np.ndarray:
    return np.array([LAST if x is None else x for x in ids.to_pylist()], np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers above their least one, in as few bytes each as hold them."""
    least = values.min()
    above = (values - least).view(np.uint64)
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(above.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + least.tobytes() + above.astype(kind).tobytes()


def _widened(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=9).astype(np.int64) + np.frombuffer(blob, np.int64, 1, 1)[0]


class Asked:
    """The windows of a pack that a level asks for, each once and in one order, by bucket."""

    def __init__(self, keys: tuple[np.ndarray, np.ndarray], ids: np.ndarray, shift: int):
        h, c = keys
        self.ids, n = ids, len(h)
        order = np.lexsort((c, h)) if c.any() else np.argsort(h, kind="stable")
        h, c, ids = h[order], c[order], ids[order]
        opens = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[:n]
        starts = np.flatnonzero(opens)
        self.which = np.empty(n, np.int64)
        self.which[order] = np.cumsum(opens) - 1
        self.h, self.c = h[starts], c[starts]
        self.lo, self.hi = (np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)) if n else (ids, ids)
        bucket = (self.h >> np.uint64(shift)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, np.int64)
        self.parts = {int(bucket[a]): slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(bucket)])}

    def requests(self, block: int) -> Iterator[pa.RecordBatch]:
        for bucket, own in self.parts.items():
            c = self.c[own].tobytes() if self.c.any() else None
            lo, hi = self.lo[own], self.hi[own]
            yield _row("request", block, at=bucket, h=self.h[own].tobytes(), c=c, lo=_narrow(lo), hi=_narrow(hi - lo) if (hi > lo).any() else None)

    def answered(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """For each window asked for: whether several ids have it, and whether a smaller one than its own does."""
        repeated, earlier = np.zeros(len(self.h), bool), np.zeros(len(self.h), bool)
        for bucket, r, e in zip(*(answers.column(k).to_pylist() for k in ("at", "repeated", "earlier"))):
            if r is not None:
                own = self.parts[bucket]
                for out, bits in ((repeated, r), (earlier, e)):
                    out[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=own.stop - own.start)
        return repeated[self.which], earlier[self.which] | (self.ids > self.lo[self.which])


def _repeated(table: pa.Table) -> pa.Table:
    """What packs asked of one bucket: for each row a bit a window, set if several ids have it, and one if an id below the row's own does."""
    blobs = {k: table.column(k).to_pylist() for k in ("h", "c", "lo", "hi")}
    n = [len(x) // 8 for x in blobs["h"]]
    h = np.frombuffer(b"".join(blobs["h"]), np.uint64)
    c = np.concatenate([np.zeros(k, np.uint32) if x is None else np.frombuffer(x, np.uint32) for k, x in zip(n, blobs["c"])])
    lo = np.concatenate([_widened(x) for x in blobs["lo"]])
    hi = lo + np.concatenate([np.zeros(k, np.int64) if x is None else _widened(x) for k, x in zip(n, blobs["hi"])])
    order = np.lexsort((c, h)) if c.any() else np.argsort(h)
    hs, cs = h[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])]))
    least, most = np.minimum.reduceat(lo[order], starts), np.maximum.reduceat(hi[order], starts)
    sizes = np.diff(np.concatenate([starts, [len(h)]]))
    repeated, earlier = np.empty(len(h), bool), np.empty(len(h), bool)
    repeated[order] = np.repeat(least < most, sizes)
    earlier[order] = np.repeat(least, sizes) < lo[order]
    cuts = np.cumsum(n)[:-1]
    bits = [pa.array([np.packbits(x).tobytes() for x in np.split(flags, cuts)], pa.binary()) for flags in (repeated, earlier)]
    return pa.table([table.column("block"), table.column("at"), *bits, pa.nulls(len(n), pa.list_(pa.int64()))], ["block", "at", "repeated", "earlier", "copies"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in packs, and one row a text with the digest of its words."""
    for batch in batches:
        for part in words.chunks(batch, "text", PACK_BYTES):
            block, n = uuid.uuid4().int >> 65, part.num_rows
            split = [t.encode().split() for t in part.column("text").to_pylist()]
            state = [part.column("doc_id").cast(pa.int64()), part.column("text"), pa.array([0] * n, pa.int64()), pa.nulls(n, pa.string()), pa.array([0] * n, pa.int64())]
            yield _row("pack", block, at=sum(map(len, split)), pack=_packed(pa.RecordBatch.from_arrays(state, schema=_STATE)))
            digests = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in split]
            long = [i for i in range(n) if len(split[i]) >= WINDOW]
            values = {
                "kind": ["copy"] * len(long), "block": [block] * len(long), "at": long,
                "id": _order(part.column("doc_id"))[long], "h": [digests[i] for i in long],
            }
            columns = [pa.array(values[k], t) if k in values else pa.nulls(len(long), t) for k, t in zip(_ROW_NAMES, _ROW_TYPES)]
            yield pa.RecordBatch.from_arrays(columns, _ROW_NAMES)


def _asked_at_base(win: Windows, ids: np.ndarray, shift: int) -> tuple[Asked, np.ndarray, np.ndarray, np.ndarray]:
    value, least, anchors = win.least(BASE, WINDOW - BASE + 1)
    return Asked((value[anchors], np.zeros(len(anchors), np.uint32)), ids[win.owner[anchors]], shift), value, least, anchors


def _base_requests(shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pack in zip(batch.column("block").to_pylist(), batch.column("pack")):
                state = _unpacked(pack.as_py())
                yield from _asked_at_base(Windows(state.column("text")), _order(state.column("doc_id")), shift)[0].requests(block)

    return run


def _kept_digest(text: str, keep: np.ndarray | None) -> str:
    split = text.encode().split()
    return hashlib.sha256(b" ".join(split if keep is None else (w for w, k in zip(split, keep.tolist()) if k))).hexdigest()


def _finished(block: int, state: pa.RecordBatch, n_words: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(rows):
        own = state.take(pa.array(rows))
        columns = [own.column("doc_id"), pa.array(n_words[rows]), *(own.column(c) for c in ("n_removed", "kept_sha256", "longest"))]
        yield _row("done", block, pack=_packed(pa.RecordBatch.from_arrays(columns, schema=_DONE)))


def _replaced(state: pa.RecordBatch, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], f.type) if (k := f.name) in columns else state.column(k) for f in _STATE], schema=_STATE)


def _as_table(parts: Iterator[pa.RecordBatch]) -> pa.Table:
    kept = list(parts)
    return pa.Table.from_batches(kept) if kept else pa.table([pa.nulls(0, t) for t in _ROW_TYPES], _ROW_NAMES)


def _go_on(block: int, state: pa.RecordBatch, win: Windows, length: int, at: np.ndarray, ids: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
    """Texts without a window to ask for are done; the others go on in a pack of their own, with these windows' places."""
    more = np.zeros(len(ids), bool)
    more[win.owner[at]] = True
    yield from _finished(block, state, win.counts, np.flatnonzero(~more))
    if more.any():
        yield from Asked(win.keys(length, at), ids[win.owner[at]], shift).requests(block)
        gone = np.concatenate([[0], np.cumsum(np.where(more, 0, win.counts))])
        places = pa.RecordBatch.from_arrays([pa.array(np.diff(at - gone[win.owner[at]], prepend=0))], ["step"])
        yield _row("pack", block, h=_packed(places), pack=_packed(state.take(pa.array(np.flatnonzero(more)))))


def _from_base(shift: int):
    """Windows whose anchor is repeated are asked for; copies and texts without such windows are done."""

    def parts(packs: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        block, state = packs.column("block")[0].as_py(), _unpacked(packs.column("pack")[0].as_py())
        win, ids = Windows(state.column("text")), _order(state.column("doc_id"))
        copy = np.zeros(len(ids), bool)
        copy[[i for x in answers.column("copies").to_pylist() if x for i in x]] = True
        asked, value, least, anchors = _asked_at_base(win, ids, shift)
        repeated, _ = asked.answered(answers)
        kept = np.full(win.total + WINDOW - BASE + 1, NONE)
        kept[anchors[repeated]] = value[anchors[repeated]]
        hit = _sliding(np.minimum, kept, WINDOW - BASE + 1)[: win.total] == least
        at = np.flatnonzero(hit & (win.left >= WINDOW) & ~copy[win.owner])
        on = np.zeros(len(ids), bool)
        on[win.owner[at]] = True
        gone = hashlib.sha256(b"").hexdigest()
        digests = [None if m else gone if d else _kept_digest(t, None) for t, m, d in zip(state.column("text").to_pylist(), on, copy)]
        state = _replaced(state, n_removed=np.where(copy, win.counts, 0), kept_sha256=digests, longest=np.where(copy, win.counts, 0))
        yield from _go_on(block, state, win, WINDOW, at, ids, shift)

    return lambda packs, answers: _as_table(parts(packs, answers))


def _doubled(length: int, shift: int):
    """What the repeated windows of one length remove (at WINDOW), and which of them are extended to twice the length."""

    def parts(packs: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        block, state = packs.column("block")[0].as_py(), _unpacked(packs.column("pack")[0].as_py())
        win, ids = Windows(state.column("text")), _order(state.column("doc_id"))
        at = np.cumsum(_unpacked(packs.column("h")[0].as_py()).column("step").to_numpy())
        repeated, again = Asked(win.keys(length, at), ids[win.owner[at]], shift).answered(answers)
        longest = state.column("longest").to_numpy().copy()
        longest[win.owner[at[again]]] = length
        state = _replaced(state, longest=longest)
        on = at[repeated]
        if length == WINDOW:
            step = np.zeros(win.total + WINDOW + 1, np.int64)
            step[at[again]] += 1
            step[at[again] + WINDOW] -= 1
            removed = np.cumsum(step)[: win.total] > 0
            n_removed = np.bincount(win.owner[removed], minlength=len(ids))
            digests = [_kept_digest(t, ~removed[a:b] if r else None) for t, a, b, r in zip(state.column("text").to_pylist(), win.first[:-1], win.first[1:], n_removed)]
            state = _replaced(state, n_removed=n_removed, kept_sha256=digests)
            # from here on windows begin at the least of each stretch, which equal passages have in common
            on = np.intersect1d(on, win.least(WINDOW, SPREAD)[2])
        yield from _go_on(block, state, win, 2 * length, on[win.left[on] >= 2 * length], ids, shift)

    return lambda packs, answers: _as_table(parts(packs, answers))


def _unpack_done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.column("pack"):
            yield _unpacked(pack.as_py())


def _step(rows: DataFrame, answers: DataFrame, task: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    packs = rows.where("kind = 'pack'").select("block", "h", "pack")
    return materialise(packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(task, ROW))


def _answered(requests: DataFrame) -> DataFrame:
    return requests.select("block", "at", "h", "c", "lo", "hi").groupBy("at").applyInArrow(_repeated, ANSWER)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and longest of every row of ``docs`` (doc_id, text; others are ignored).

    A word goes if a window of WINDOW words over it also stands in a row with a smaller id; windows are those of the
    input.  longest is the greatest tried length at which a window of the row stands in a row with a smaller id (WINDOW,
    doubled again and again; all words of a whole copy; 0 for none): a passage SPREAD words longer than a length is seen at it.

    Null and empty texts have no words and the digest of the empty text.  Rows with equal ids do not remove
    each other's words.  A null id counts as later than all others, and null ids as equal.  Repeated
    rows keep their rows; an empty table stays empty; texts are taken whole, whatever their length.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = materialise(texts.mapInArrow(_pack, ROW))
    total = rows.where("kind = 'pack'").agg(F.coalesce(F.sum("at"), F.lit(0))).first()[0]
    shift = 64 - max(total // BUCKET_WORDS, 1).bit_length()

    copies = rows.where("kind = 'copy'").select("block", "at", "id", F.col("h").alias("digest"))
    firsts = copies.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    later = copies.join(firsts.select(F.col("digest").alias("copied"), "first"), (F.col("digest") == F.col("copied")) & (F.col("id") > F.col("first")))
    later = later.groupBy("block").agg(F.collect_list("at").alias("copies"))  # as many as a pack has texts at most
    none = F.lit(None)
    later = later.select("block", none.cast("bigint").alias("at"), none.cast("binary").alias("repeated"), none.cast("binary").alias("earlier"), "copies")

    packs = rows.where("kind = 'pack'").select("block", "pack")
    answers = _answered(packs.mapInArrow(_base_requests(shift), ROW)).unionByName(later)
    done, length = [], WINDOW
    rows = _step(rows, answers, _from_base(shift))
    while True:
        done.append(rows.where("kind = 'done'").select("pack"))
        requests = rows.where("kind = 'request'")
        if requests.isEmpty():
            break
        rows = _step(rows, _answered(requests), _doubled(length, shift))
        length *= 2
    parts = done[0]
    for more in done[1:]:
        parts = parts.unionByName(more)
    return parts.mapInArrow(_unpack_done, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, longest bigint")


#: The removal in DuckDB, over all windows as texts.
SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM texts WHERE len(w) >= 13)
), firsts AS (
  SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT rid, list(DISTINCT p) AS ps
  FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (s) WHERE doc_id > first_id) GROUP BY rid
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS s
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts) t
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT rid AS r, unnest(ps) AS q FROM gone) g WHERE g.r = t.rid AND g.q = t.p) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM texts LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""
