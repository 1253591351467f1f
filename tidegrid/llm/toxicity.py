"""Toxicity from averaged subword embeddings and a linear softmax, trained jointly in numpy.

A bag holds the words of a passage and their character n-grams; its embedding is their mean, and a linear
softmax over it gives the probability.  N-grams share buckets across words, so a misspelling that was
never seen still meets vectors that were trained.  A document scores as its most toxic passage does:
a mean over a long text would drown a few words.

Training takes a bounded sample of labelled rows; scoring takes whole texts of all rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.llm import words
from tidegrid.llm.folds import remainder

#: Buckets of subwords (ids fit 16 bits), lengths of the n-grams in bytes, numbers of an embedding.
BUCKETS, LENGTHS, DIMENSIONS = 1 << 16, (3, 4, 5), 8
#: Words of a passage and between the starts of two.
PASSAGE, STRIDE = 4, 2
#: Bound of the training sample: rows of each class, and bytes of text of all, of which each class may take half.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 24 << 20
#: Bytes of text whose subwords are sorted at a time.
FIT_BYTES = 1 << 18
EPOCHS, BATCH, RATE, DECAY, SEED = 14, 512, 0.02, 0.3, 5
#: Subwords in fewer sampled texts stay at zero; texts that the first log odds are drawn to no difference by.
LEAST_DOCS, PRIOR_DOCS = 4, 20
THRESHOLD = 0.3
_FACTORS = (np.random.default_rng(3).integers(1 << 31, 1 << 32, max(LENGTHS)) | 1).astype(np.uint32)


@dataclasses.dataclass
class Subwords:
    """Subword buckets of consecutive texts, in the order of words; ``word_first`` and ``text_first`` cut them."""

    ids: np.ndarray
    word_first: np.ndarray
    text_first: np.ndarray


def _layout(column: pa.Array) -> tuple[np.ndarray, words.Words]:
    """Lower-case bytes with one space before each text and some after the last, spaces all alike, and their words."""
    data, offsets = words.text_bytes(column)
    n = len(offsets) - 1
    spaced = np.full(len(data) + n + max(LENGTHS), 0x20, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = words.LOWER[data]
    spaced[words.IS_SPACE[spaced]] = 0x20
    return spaced, words.Words(spaced, offsets + np.arange(n + 1))


def _grams(spaced: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first byte, bucket) of the n-grams that lie in a word and the spaces around it."""
    space = spaced == 0x20
    wide = spaced.astype(np.uint32)
    total = np.zeros(len(spaced), np.uint32)
    inner = np.ones(len(spaced), bool)
    for n in range(1, max(LENGTHS) + 1):
        total[: len(spaced) - n + 1] += wide[n - 1 :] * _FACTORS[n - 1]
        if n >= 3:
            inner[: len(spaced) - n + 2] &= ~space[n - 2 :]
        if n in LENGTHS:
            at = np.flatnonzero(inner[: max(0, len(spaced) - n + 1)])
            h = total[at] ^ (total[at] >> np.uint32(15))
            yield at, ((h * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(16)).astype(np.uint16)


def _word_buckets(found: words.Words) -> np.ndarray:
    return (found.hashes() >> np.uint64(48)).astype(np.uint16)


def subwords(column: pa.Array) -> Subwords:
    spaced, found = _layout(column)
    places, ids = zip(*_grams(spaced), (found.start - 1, _word_buckets(found)))
    places, ids = np.concatenate(places), np.concatenate(ids)
    # the n-grams of a word begin no earlier than the space before it
    owner = np.searchsorted(found.start - 1, places, "right") - 1
    order = np.argsort(owner, kind="stable")
    return Subwords(ids[order], np.searchsorted(owner[order], np.arange(len(found.start) + 1)), found.first)


def passages(text_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of all passages, and which of them are whose: every word is in at least one."""
    n = np.diff(text_first)
    per_text = np.maximum(0, -(-(n - PASSAGE) // STRIDE)) + (n > 0)
    first = np.concatenate([[0], np.cumsum(per_text)])
    step = np.arange(first[-1]) - np.repeat(first[:-1], per_text)
    start = np.repeat(text_first[:-1], per_text) + step * STRIDE
    return start, np.minimum(start + PASSAGE, np.repeat(text_first[1:], per_text)), first


def _highest(values: np.ndarray, first: np.ndarray, empty: float) -> np.ndarray:
    """The highest value of each run; of an empty run, ``empty``."""
    out = np.full(len(first) - 1, empty)
    full = np.diff(first) > 0
    if full.any():
        out[full] = np.maximum.reduceat(values, first[:-1][full])
    return out


class Model:
    """The trained layers, folded: the logit of a bag is the mean of one number a subword, plus a bias.

    An empty bag has the log odds of label 1 among all labelled rows.
    """

    def __init__(self, weight: np.ndarray, bias: float, empty: float):
        self.weight, self.bias, self.empty = weight.astype(np.float32), float(bias), float(empty)

    def scores(self, column: pa.Array) -> np.ndarray:
        spaced, found = _layout(column)
        sums, counts = np.zeros(len(spaced) + 1), np.zeros(len(spaced) + 1)
        for at, ids in _grams(spaced):
            sums[at] += self.weight[ids]
            counts[at] += 1
        sums[found.start - 1] += self.weight[_word_buckets(found)]
        counts[found.start - 1] += 1
        sums, counts = (np.concatenate([[0], np.cumsum(x)]) for x in (sums, counts))
        edge = np.concatenate([found.start - 1, [len(spaced)]])
        start, end, first = passages(found.first)
        n = counts[edge[end]] - counts[edge[start]]
        logits = (sums[edge[end]] - sums[edge[start]]) / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(_highest(logits, first, self.empty), -60, 60)))


def _word_sums(weight: np.ndarray, ids: np.ndarray, word_first: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's subwords; every word has one at least."""
    out = np.zeros(len(word_first) - 1)
    step = 100_000
    for a in range(0, len(out), step):
        cut = word_first[a : a + step + 1]
        out[a : a + step] = np.add.reduceat(weight[ids[cut[0] : cut[-1]]], cut[:-1] - cut[0])
    return out


def fit(texts: pa.Array, labels: np.ndarray, share: float) -> Model:
    """Embeddings and softmax on the passages that decide, chosen anew in each epoch.

    At first the passages with the highest mean log odds of their subwords decide; then those that the
    model itself scores highest do, and for label 0 another one drawn at random.  The classes weigh as in all labelled
    rows, of which ``share`` have label 1.
    """
    rng, empty = np.random.default_rng(SEED), np.log((share + 1e-3) / (1 - share + 1e-3))
    parts, text_words, sub_first, at = [], [0], [np.zeros(1, np.int64)], 0
    for part in words.chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text", FIT_BYTES):
        found = subwords(part.column("text"))
        parts.append(found.ids)
        sub_first.append(found.word_first[1:] + at)
        text_words += list(found.text_first[1:] + text_words[-1])
        at += len(found.ids)
    ids, word_first, text_first = np.concatenate([*parts, np.zeros(0, np.uint16)]), np.concatenate(sub_first), np.array(text_words)
    start, end, first = passages(text_first)
    low, high = word_first[start], word_first[end]
    full = np.flatnonzero(np.diff(first) > 0)
    positive = labels == 1
    if not len(full) or not len(labels) or positive.all() or not positive.any():
        return Model(np.zeros(BUCKETS), empty, empty)

    seen = np.zeros((2, BUCKETS))
    bounds = word_first[text_first]
    for i in range(len(labels)):
        seen[int(labels[i]), np.unique(ids[bounds[i] : bounds[i + 1]])] += 1
    prior = positive.mean()
    weight = np.log((seen[1] + PRIOR_DOCS * prior) / (seen[0] + PRIOR_DOCS * (1 - prior))) - np.log(prior / (1 - prior))
    rare = seen.sum(0) < LEAST_DOCS

    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    layer, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    held = [[np.zeros_like(x), np.zeros_like(x)] for x in (embed, layer, bias)]
    class_weight = np.where(positive, share / positive.mean(), (1 - share) / (~positive).mean())
    step = 0
    for _ in range(EPOCHS):
        sums = np.concatenate([[0.0], np.cumsum(_word_sums(weight, ids, word_first))])
        mean = (sums[end] - sums[start]) / np.maximum(high - low, 1)
        top = np.array([first[i] + np.argmax(mean[first[i] : first[i + 1]]) for i in full])
        spare = full[labels[full] == 0]
        drawn = first[spare] + (rng.random(len(spare)) * np.diff(first)[spare]).astype(int)
        bags, owner = np.concatenate([top, drawn]), np.concatenate([full, spare])
        order = rng.permutation(len(bags))
        for b in range(0, len(order), BATCH):
            chosen = order[b : b + BATCH]
            bag, y, w = bags[chosen], labels[owner[chosen]], class_weight[owner[chosen]]
            size = high[bag] - low[bag]
            row = np.repeat(np.arange(len(bag)), size)
            member = ids[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[bag], size)]
            each = 1 / size[row]
            mean_vectors = np.stack([np.bincount(row, embed[member, d] * each, len(bag)) for d in range(DIMENSIONS)], 1)
            logits = mean_vectors @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(bag)), y] -= 1
            p *= (w / w.sum())[:, None]
            back = p @ layer.T
            slopes = [
                np.stack([np.bincount(member, back[row, d] * each, BUCKETS) for d in range(DIMENSIONS)], 1),
                mean_vectors.T @ p + 1e-4 * layer,
                p.sum(0),
            ]
            step += 1
            for x, slope, (m, v) in zip((embed, layer, bias), slopes, held):
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                x -= RATE * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + DECAY * x)
            embed[rare] = 0
        weight = embed @ (layer[:, 1] - layer[:, 0])
    return Model(weight, bias[1] - bias[0], empty)


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


def within_bytes(batches: Iterator[pa.RecordBatch], most_bytes: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of each class in their order, whole ones until its bytes are used up.

    A class may take half of the bytes and what the other one leaves, and one text at least.
    """
    kept, held = [], [0, 0]
    for batch in batches:
        for part in words.chunks(batch, "text", 1 << 20):
            size, toxic = pc.binary_length(part.column("text")).to_numpy(), part.column("toxic").to_numpy()
            keep = np.zeros(len(size), bool)
            for k in (0, 1):
                mine = np.flatnonzero(toxic == k)
                keep[mine] = held[k] + np.cumsum(size[mine]) - size[mine] < most_bytes
                held[k] += int(size[mine][keep[mine]].sum())
            if keep.any():
                kept.append(part.filter(pa.array(keep)))
    if not kept:
        return pa.array([], pa.string()), np.zeros(0, int)
    table = pa.Table.from_batches(kept)
    texts, toxic = table.column("text").combine_chunks(), table.column("toxic").to_numpy()
    size, keep = pc.binary_length(texts).to_numpy(), np.zeros(len(toxic), bool)
    for k in (0, 1):
        mine = np.flatnonzero(toxic == k)
        keep[mine] = np.cumsum(size[mine]) - size[mine] < max(most_bytes / 2, most_bytes - held[1 - k])
    return texts.filter(pa.array(keep)), toxic[keep]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from a bounded sample of the labelled rows of ``docs`` that are not held out.

    The sample takes ``rows`` ids of each class in the order of a hash, and of their texts as many whole
    ones as ``most_bytes`` hold, with a share for each class.  Labels that are null or of ids without a row teach nothing; with one class
    or none every text gets the share of label 1.  The fit is one task; its result is one number a bucket.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.where(~held_out(F.col("doc_id")))
    n, positives = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = positives / n if n else 0.0
    order = F.xxhash64("doc_id", F.lit(SEED))
    sample = usable.where("toxic = 1").orderBy(order).limit(rows).union(usable.where("toxic = 0").orderBy(order).limit(rows))
    # at most 2 * rows ids and labels are sent
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = within_bytes(batches, most_bytes)
        model = fit(texts, y, share)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()]), pa.array([model.bias]), pa.array([model.empty])], ["weight", "bias", "empty"])

    spread = picked.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(SEED)), "toxic")
    fitted = spread.select("text", "toxic").mapInArrow(run, "weight binary, bias double, empty double").first()
    if fitted is None:  # no task ran at all
        return fit(pa.array([], pa.string()), np.zeros(0, int), share)
    weight, bias, empty = fitted
    return Model(np.frombuffer(weight, np.float32), bias, empty)


#: Bytes of text that are scored at a time.
SCORE_BYTES = 256 << 10


def scores_of(model: Model):
    """The score of a text column, from the texts alone: other columns of the rows stay out of Python."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = words.chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SCORE_BYTES)
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(p.column("text")) for p in parts)]))

    return score


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, ...) with toxic_score, a column of this name being replaced.

    Null and empty texts score as an empty bag.  A row is scored by itself and from its text alone:
    repeated rows score alike, an empty table stays empty, long texts are cut into passages.
    """
    return docs.drop("toxic_score").withColumn("toxic_score", scores_of(model)(F.col("text")))
