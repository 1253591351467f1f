"""Near duplicates by word n-grams: a Jaccard join through T-occurrence search over inverted lists.

Method (DivideSkip): a document's sorted n-grams are split into rare ones, whose inverted lists are
short and merged, and frequent ones, whose lists are long and only probed.  A partner must share T n-grams,
so at least T - L of the merged lists if L are left to be probed; those that do are probed by binary search
in the sorted n-grams, and kept if the overlap reaches T.  L is the largest that loses no partner.

Groups of near copies would merge into all their pairs.  Equal sets are one class from the start;
then each document is compared with the likeliest of a few pivots of its lists, which joins most of a group into
one component; then only documents of different components meet, first the likeliest partners and in
the end every one.  So the components are exact, while pairs inside a component are left out once it is connected.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm import graph, words
from tidegrid.llm.folds import unused_names
from tidegrid.sources.tables import materialise

#: Bytes of text whose sets are made at a time.
SET_BYTES = 512 << 10
#: Words of an n-gram, and the similarity of a link in percent.
NGRAM, PERCENT = 5, 80
#: Counters that tell rare from frequent n-grams, bits that tell whose texts are asked for, and the pieces in which
#: both travel.  They are of this size for any input.
COUNTERS, BITS, PIECES = 1 << 20, 1 << 25, 64
#: Documents of a list that its others are counted with at first, and how many of these a document is compared with.
PIVOTS, BEST = 3, 2
#: Likeliest partners in other components that a document is compared with next, before all that are left.
TRIES = 4
#: Partners that one row of the second phase carries, and those of one batch of rows.
PACK, BATCH = 1024, 1 << 18
#: Lists with more pairs of different components than those of so many documents are cut into blocks.
SPLIT = 2000


def prefix_length(n, percent: int = PERCENT):
    """How many of n sorted n-grams are merged: all but the T - 1 most frequent, T the least overlap with any partner."""
    return n - -(-n * percent // 100) + 1


def least_overlap(n, m, percent: int = PERCENT):
    return -(-percent * (n + m) // (100 + percent))


def _sizes_agree(n, m, percent: int):
    return np.minimum(n, m) * 100 >= np.maximum(n, m) * percent


def ngram_sets(column: pa.Array, ngram: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a shorter text is one n-gram, one without words none."""
    data, offsets = words.text_bytes(column)
    hashes, first = words.shingles(words.Words(data, offsets, lower=True), ngram)
    for a, b in zip(first[:-1], first[1:]):
        yield np.unique(hashes[a:b])


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def _pieces(array: np.ndarray) -> tuple[pa.Array, pa.Array]:
    parts = np.split(array, PIECES)
    return pa.array(range(PIECES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())


def _merged(pieces: DataFrame, kind: str, combine) -> np.ndarray:
    """One array from the pieces of all tasks: each piece is combined by one task, the result has a fixed size."""

    def run(table: pa.Table) -> pa.Table:
        total = None
        for blob in table.column("blob"):
            part = np.frombuffer(zlib.decompress(blob.as_py()), kind)
            total = part.copy() if total is None else combine(total, part)
        return pa.table({"piece": table.column("piece")[:1], "blob": [zlib.compress(total.tobytes(), 1)]})

    rows = {r[0]: np.frombuffer(zlib.decompress(r[1]), kind) for r in pieces.groupBy("piece").applyInArrow(run, "piece int, blob binary").collect()}
    return np.concatenate([rows[i] for i in range(PIECES)]) if rows else np.zeros(0, kind)


def _profiles(ngram: int):
    """Digest and size of each text's set; at the end of a partition, its n-gram counts in pieces."""
    names = ["doc_id", "digest", "n", "piece", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in words.chunks(batch, "text", SET_BYTES):
                sets = list(ngram_sets(part.column("text"), ngram))
                counts += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS)
                digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                n, none = pa.array([len(s) for s in sets], pa.int64()), len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), digests, n, pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names
                )
        piece, blob = _pieces(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.binary()), pa.nulls(PIECES, pa.int64()), piece, blob], names
        )

    return run


def _prefixes(counts: np.ndarray, ngram: int, percent: int):
    """The n-grams of each text whose lists are merged, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text", SET_BYTES):
                out, sizes = [], []
                for s in ngram_sets(part.column("text"), ngram):
                    order = np.lexsort((s, counts[_counter(s)]))
                    out.append(s[order[: prefix_length(len(s), percent) if len(s) else 0]].tobytes())
                    sizes.append(len(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc", "n", "prefix"]
                )

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            prefixes = [np.frombuffer(b.as_py(), np.int64) for b in part.column("prefix")]
            k = np.array([len(p) for p in prefixes])
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            doc, n = (np.repeat(part.column(c).to_numpy(), k) for c in ("doc", "n"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])), pa.array(doc), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))],
                ["token", "doc", "n", "pos"],
            )


POSTING = "token bigint, doc bigint, n int, pos int"


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of a stream sorted by its first column, and where each run of that begins; no run is cut."""
    held = None
    for batch in batches:
        arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            arrays = [np.concatenate([h, x]) for h, x in zip(held, arrays)]
        if not len(arrays[0]):
            continue
        last = np.searchsorted(arrays[0], arrays[0][-1])
        held = [x[last:] for x in arrays]
        done = [x[:last] for x in arrays]
        if last:
            yield done, np.flatnonzero(np.concatenate([[True], done[0][1:] != done[0][:-1]]))
    if held is not None and len(held[0]):
        yield held, np.zeros(1, np.int64)


LISTED = f"{POSTING}, many bigint"


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the lists that have two documents or more, with their number."""
    names = ["token", "doc", "n", "pos"]
    for columns, starts in _runs(batches, names):
        length = np.diff(np.concatenate([starts, [len(columns[0])]]))
        keep = np.repeat(length > 1, length)
        if keep.any():
            many = np.repeat(length, length).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in [*columns, many]], [*names, "many"])


def _pivot_pairs(percent: int):
    """Each list's first documents (x, its pivots) with all later ones (y) whose size allows a link.

    A pair comes with its sizes and with the number of lists of this stretch that hold it.  Lists have their documents
    in one order, so a pair has the same pivot in all of them.
    """
    names = ["x", "y", "nx", "ny", "lists"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, doc, n, _), starts in _runs(batches, ["token", "doc", "n", "pos"]):
            n, ends = n.astype(np.int64), np.concatenate([starts[1:], [len(doc)]])
            found = []
            for i in range(PIVOTS):
                pivot = starts + i
                later = np.maximum(ends - pivot - 1, 0)
                a = np.repeat(pivot, later)
                b = a + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
                fit = (doc[a] != doc[b]) & _sizes_agree(n[a], n[b], percent)
                found.append(np.stack([doc[a][fit], doc[b][fit], n[a][fit], n[b][fit]], 1))
            pairs, lists = np.unique(np.concatenate(found), axis=0, return_counts=True)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in pairs.T), pa.array(lists)], names)

    return run


def _often_enough(percent: int):
    """Whether the lists that hold a pair suffice, as columns: those that are only probed could give the rest."""
    share = lambda n: F.ceil(n * percent / 100) - 1
    need = F.ceil((F.col("nx") + F.col("ny")) * percent / (100 + percent))
    return F.col("lists") + F.greatest(share(F.col("nx")), share(F.col("ny"))) >= need


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of each document's pivots the BEST ones by the lists they share; there are PIVOTS a list at most."""
    score = F.struct((F.col("lists") / (F.col("nx") + F.col("ny"))).alias("score"), F.col("x"), F.col("y"))
    ranked = pairs.groupBy("y").agg(F.slice(F.sort_array(F.collect_list(score), asc=False), 1, BEST).alias("best"))
    return ranked.select(F.explode("best").alias("one")).select("one.x", "one.y")


def _in_blocks(labelled: DataFrame) -> DataFrame:
    """The lists (list, doc, label, size and n, pos and side in one number), with long ones of many components cut.

    Documents of a cut list are dealt to blocks, and each pair of blocks is a list of its own, so that no task has all
    pairs.  In it side tells the blocks apart; it is 0 where all documents meet.
    """
    held = labelled.where(F.col("many") > SPLIT).groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    sums = held.groupBy(F.col("token").alias("long")).agg(F.sum("c").alias("all"), F.sum(F.col("c").cast("double") * F.col("c")).alias("same"))
    apart = F.sqrt(F.col("all").cast("double") * F.col("all") - F.col("same"))
    cuts = materialise(sums.select("long", F.ceil(apart / SPLIT).cast("int").alias("cuts")).where("cuts > 1"))
    shape = lambda side: F.expr("shiftleft(cast(n AS bigint), 32) + shiftleft(cast(pos AS bigint), 2)") + side
    if cuts.isEmpty():
        return labelled.select(F.col("token").alias("list"), "doc", "label", "size", shape(F.lit(0)).alias("shape"))
    blocked = labelled.join(cuts, F.col("token") == F.col("long"), "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("cuts")).cast("int"))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    pair = F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return blocked.select(F.when(F.col("cuts") == 1, F.col("token")).otherwise(pair).alias("list"), "doc", "label", "size", shape(side).alias("shape"))


def _minor_rows(percent: int):
    """For each list of several components, each document with those of larger components, packed.

    Larger is by (documents, label) over all documents, so that all lists put a pair to the same one of the two, whose
    count is then whole.  Partners whose size or place in the list's order allows no link are left out: what two
    documents share lies before this n-gram in both or after it in both.
    """
    kinds = (pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for (_, doc, label, size, shape), starts in _runs(batches, ["list", "doc", "label", "size", "shape"]):
            ends = np.concatenate([starts[1:], [len(doc)]])
            mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
            for a, b in zip(starts[mixed], ends[mixed]):
                order = a + np.lexsort((label[a:b], size[a:b]))
                n, pos, side = shape[order] >> 32, (shape[order] & 0xFFFFFFFF) >> 2, shape[order] & 3
                members = np.stack([doc[order], n], 1)
                component = np.concatenate([[0], np.cumsum(label[order][1:] != label[order][:-1])])
                follows = np.searchsorted(component, component, "right")
                for i in range(b - a):
                    m, q = n[follows[i] :], pos[follows[i] :]
                    most = np.minimum(pos[i], q) + np.minimum(n[i] - pos[i], m - q)
                    fit = _sizes_agree(n[i], m, percent) & (most >= least_overlap(n[i], m, percent))
                    partners = members[follows[i] :][fit & ((side[i] == 0) | (side[follows[i] :] != side[i]))]
                    for c in range(0, len(partners), PACK):
                        rows.append((int(members[i, 0]), int(n[i]), partners[c : c + PACK].tobytes()))
                        held += len(partners[c : c + PACK])
                    if held >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["y", "n", "partners"])
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["y", "n", "partners"])

    return run


def _merge_counted(percent: int, tries: int | None):
    """Merges the lists of each document and keeps the partners found in T - L of them: all, or the likeliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ys, ns, blobs), _ in _runs(batches, ["y", "n", "partners"]):
            # an id may stand for texts of different sizes
            starts = np.flatnonzero(np.concatenate([[True], (ys[1:] != ys[:-1]) | (ns[1:] != ns[:-1])]))
            for a, b in zip(starts, np.concatenate([starts[1:], [len(ys)]])):
                partners = np.frombuffer(b"".join(blobs[a:b]), np.int64).reshape(-1, 2)
                # (partner, size) rows are sorted like the heads of a heap of lists would come out
                who, count = np.unique(partners, axis=0, return_counts=True)
                n, m = int(ns[a]), who[:, 1]
                probed = np.maximum(n - prefix_length(n, percent), m - prefix_length(m, percent))
                keep = _sizes_agree(n, m, percent) & (count + probed >= least_overlap(n, m, percent))
                if keep.any():
                    kept = np.flatnonzero(keep)
                    if tries is not None:
                        kept = kept[np.argsort(-count[kept] / (n + m[kept]), kind="stable")[:tries]]
                    z = who[kept, 0]
                    y = np.full(len(z), ys[a])
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(y, z)), pa.array(np.maximum(y, z))], ["x", "y"])

    return run


def _bit(ids: np.ndarray) -> np.ndarray:
    return (words.mixed(ids.view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS, bool)
    for batch in batches:
        for column in ("x", "y"):
            bits[_bit(batch.column(column).to_numpy())] = True
    piece, blob = _pieces(np.packbits(bits))
    yield pa.RecordBatch.from_arrays([piece, blob], ["piece", "blob"])


def _asked_bits(ids: DataFrame) -> np.ndarray:
    """The bitmap of the ids in x and y, of a fixed size; a bit may be set for other ids too."""
    bits = _merged(ids.mapInArrow(_bitmap, "piece int, blob binary"), "u1", np.bitwise_or)
    return bits if len(bits) else np.zeros(BITS // 8, np.uint8)


def _may_be_asked(asked: np.ndarray):
    """Whether an id may be in the bitmap; a null id cannot.  Only ids go through Python, the rows' other columns don't."""

    @F.arrow_udf("boolean")
    def test(ids: pa.Array) -> pa.Array:
        at = _bit(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.array(((asked[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1) & ids.is_valid().to_numpy(zero_copy_only=False))

    return test


def _probe(ngram: int, percent: int):
    """Pairs whose overlap, found by binary search of the smaller set in the larger one, makes a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "x_text", SET_BYTES):
                first = ngram_sets(part.column("x_text"), ngram)
                linked = []
                for s, t in zip(first, (u for piece in words.chunks(part, "y_text", SET_BYTES) for u in ngram_sets(piece.column("y_text"), ngram))):
                    small, large = (s, t) if len(s) <= len(t) else (t, s)
                    at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
                    common = int((large[at] == small).sum()) if len(large) else 0
                    linked.append(common > 0 and 100 * common >= percent * (len(s) + len(t) - common))
                yield part.select(["u", "v"]).filter(pa.array(linked))

    return run


def _linked(pairs: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The pairs (x, y) that are links, as edges (u, v).  Only the texts that are asked for move."""
    pairs = materialise(pairs.distinct())
    own = materialise(texts.where(_may_be_asked(_asked_bits(pairs))("doc")))
    joined = pairs.join(own.select(F.col("doc").alias("y"), F.col("text").alias("y_text")), "y").join(
        own.select(F.col("doc").alias("x"), F.col("text").alias("x_text")), "x"
    )
    return joined.select(F.col("x").alias("u"), F.col("y").alias("v"), "x_text", "y_text").mapInArrow(_probe(ngram, percent), "u bigint, v bigint")


def with_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row of ``docs`` (doc_id, text).

    Null text and text without words have no n-grams and no links: component_id is their own id.  Rows that
    share an id are one document with the links of all of them.  A row without an id joins the component of an equal
    set that has one; else its component is null.  Repeated rows keep their rows; an empty table stays empty.
    Texts are taken whole, and no list, component or number of partners is capped.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    profiles = materialise(texts.mapInArrow(_profiles(ngram), "doc_id bigint, digest binary, n bigint, piece int, blob binary"))
    counts = _merged(profiles.where("piece IS NOT NULL").select("piece", "blob"), "i8", np.add)
    rows = profiles.where("piece IS NULL").select("doc_id", "digest", "n")
    if not len(counts):
        counts = np.zeros(COUNTERS, np.int64)
    classes = materialise(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc")))
    with_id = texts.where("doc_id IS NOT NULL")
    prefixes = with_id.mapInArrow(_prefixes(np.minimum(counts, 2**31 - 1).astype(np.int32), ngram, percent), "doc bigint, n bigint, prefix binary")
    chosen = prefixes.join(classes.select("doc").where("doc IS NOT NULL").distinct(), "doc", "left_semi")
    spread = F.xxhash64("doc")
    postings = chosen.mapInArrow(_postings, POSTING).repartition("token").sortWithinPartitions("token")
    shared = materialise(postings.mapInArrow(_shared_lists, LISTED))

    in_lists = shared.repartition("token").sortWithinPartitions("token", spread, "doc")
    wanted = with_id.select(F.col("doc_id").alias("doc"), "text")
    with_pivots = in_lists.mapInArrow(_pivot_pairs(percent), "x bigint, y bigint, nx bigint, ny bigint, lists bigint")
    often = with_pivots.groupBy("x", "y", "nx", "ny").agg(F.sum("lists").alias("lists")).where(_often_enough(percent))
    first = _linked(_likeliest(often), wanted, ngram, percent)
    labels = materialise(graph.components(first))

    for tries in (TRIES, None):
        sizes = labels.groupBy(F.col("label").alias("whole")).agg(F.count(F.lit(1)).alias("size"))
        sized = labels.join(sizes, F.col("label") == F.col("whole")).select("node", "label", "size")
        labelled = shared.join(sized, F.col("doc") == F.col("node"), "left").select(
            "token", "doc", "n", "pos", "many", F.coalesce("label", "doc").alias("label"), F.coalesce("size", F.lit(1)).alias("size")
        )
        lists = _in_blocks(labelled).repartition("list").sortWithinPartitions("list", "doc")
        apart = lists.mapInArrow(_minor_rows(percent), "y bigint, n bigint, partners binary")
        partners = apart.repartition("y").sortWithinPartitions("y", "n").mapInArrow(_merge_counted(percent, tries), "x bigint, y bigint")
        more = _linked(partners, wanted, ngram, percent)
        # what is joined already is a star around its label
        labels = materialise(graph.components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(more)))
    final = labels

    by_class = classes.join(final, F.col("doc") == F.col("node"), "left").select(
        F.col("digest").alias("class_digest"), F.coalesce("label", "doc").alias("component")
    )
    joined = rows.join(by_class, F.col("digest") == F.col("class_digest"), "left")
    # a row whose id stands for another class as well follows that one's component
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the least id stays, once.

    Columns and their order stay.  Rows without an id are no document of any component and stay.  Only ids of
    dropped and of repeated documents meet the rows.
    """
    found = materialise(with_components(docs, ngram, percent).where("doc_id IS NOT NULL"))
    drop_id, again_id = unused_names(docs, "drop_id", "again_id")
    dropped = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias(drop_id)).distinct())
    repeated = materialise(
        found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(again_id)).count().where("count > 1").select(again_id)
    )
    # rows that the bitmap of dropped ids rules out stay where they are; only the others meet the ids
    maybe = F.coalesce(_may_be_asked(_asked_bits(dropped.select(F.col(drop_id).alias("x"), F.col(drop_id).alias("y"))))("doc_id"), F.lit(False))
    kept = docs.where(~maybe).unionByName(docs.where(maybe).join(dropped, F.col("doc_id") == F.col(drop_id), "left_anti"))
    if repeated.isEmpty():
        return kept
    is_again = F.col("doc_id") == F.col(again_id)
    again = kept.join(repeated, is_again, "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, is_again, "left_anti").unionByName(again)


#: The same in DuckDB, by counting common shingles of all pairs; for small tables.
SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT rid, s FROM (
    SELECT rid, w[i:i + 4] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)
    UNION ALL SELECT rid, w FROM texts WHERE len(w) BETWEEN 1 AND 4)
), sizes AS (
  SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), common AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL
), links AS (
  SELECT DISTINCT t.doc_id AS a, u.doc_id AS b
  FROM common JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y JOIN texts t ON t.rid = x JOIN texts u ON u.rid = y
  WHERE 100 * k >= 80 * (p.n + q.n - k)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least.b, doc_id))::BIGINT AS component_id
FROM texts LEFT JOIN sizes USING (rid) LEFT JOIN least ON least.a = doc_id
"""
