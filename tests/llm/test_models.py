import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import ctw, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Tree:
    """Context-tree weighting one decision after the other, with the weighted probabilities kept as numbers."""

    def __init__(self, depth):
        self.depth, self.nodes = depth, defaultdict(lambda: [0, 0, 0.0, 0.0])

    def path(self, context, node):
        return [(context[:d], node) for d in range(self.depth + 1)]

    def estimate(self, key, bit):
        n = self.nodes[key]
        return (n[bit] + 0.5) / (n[0] + n[1] + 1)

    def probability(self, context, node, bit, learn):
        path = self.path(context, node)
        p = self.estimate(path[-1], bit)
        new = [math.log(p)]
        for key in reversed(path[:-1]):
            own, rest = self.nodes[key][2], self.nodes[key][3]
            odds = math.exp(own - rest)
            p = (odds * self.estimate(key, bit) + p) / (odds + 1)
            new.append(math.log(p))
        if learn:
            # a node's rest is the product of its children's weighted probabilities
            for below, key in zip(new[:-1], reversed(path[:-1])):
                self.nodes[key][3] += below
            for key in path:
                self.nodes[key][2] += math.log(self.estimate(key, bit))
                self.nodes[key][bit] += 1
        return p

    def text(self, data, learn):
        past, total = [ctw.START] * self.depth, 0.0
        for byte in [*data, ctw.END]:
            node = 1
            for j in range(8):
                bit = byte >> (7 - j) & 1
                total += math.log10(self.probability(tuple(past[: self.depth]), node, bit, learn))
                node = node << 1 | bit
            past = [byte, *past]
        return total


def out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_scores_are_those_of_a_tree_walked_bit_by_bit(corpus):
    rows = [(i, f"the {'cat dog bird'.split()[i % 3]} sat {'on the mat ' * (i % 4)}é{i}") for i in range(40)] + [(41, None), (42, ""), (43, "\x00\x00")]
    tree = Tree(ctw.DEPTH)
    for i, text in rows:
        if not out(i):
            tree.text((text or "").encode(), True)
    got = {r.doc_id: r for r in ctw.lm_scores(corpus(rows)).collect()}
    for i, text in rows:
        assert got[i].score == pytest.approx(tree.text((text or "").encode(), False), rel=1e-6)
        assert got[i].held_out == out(i)


def test_the_probabilities_of_all_next_bytes_add_up_to_one():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 300) & 0x0301_0301_0307)
    context = keys[7] >> 8
    every = np.unique(np.concatenate([keys, (context << 8) | np.arange(256)]))
    n = np.where(np.isin(every, keys), 1 + every % 5, 0).astype(float)
    rows = []
    for node, _, _, (first, zeros, ones, weighted) in ctw._bits(every, n):
        rows += zip((every[first] >> 32).tolist(), node[first].tolist(), zeros, ones, weighted)
    merged = defaultdict(lambda: np.zeros(3))
    for byte, node, *more in rows:
        merged[byte, node] += more
    top = ctw.Top([(*k, *v) for k, v in merged.items()])
    p = np.ones(len(every))
    for node, bit, q, _ in ctw._bits(every, n):
        p *= top.probability(q, every >> 32, node, bit)
    assert p[every >> 8 == context].sum() == pytest.approx(1)


def test_the_word_model_and_odd_rows(odd, corpus):
    docs = odd.unionByName(corpus([(i, f"Some words {i % 7} here") for i in range(50, 90)]))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words_of = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    counts = Counter(w for i, t in rows if not fold(i) for w in words_of(t))
    total = sum(counts.values())
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in words_of(t))
    want = sorted((str(i), fold(i), len(words_of(t)), sum(counts[w] > 0 for w in words_of(t)), total, round(base(t), 6)) for i, t in rows)
    got = ctw.lm_scores(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert ctw.lm_scores(docs.where("false")).count() == 0


def test_held_out_texts_code_far_below_a_byte(spark, sf):
    r = ctw.lm_scores(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("n_bytes"), F.count(F.lit(1))).first()
    assert -r[0] * math.log2(10) / (r[1] + r[2]) < 3.0


def test_log_estimate_is_the_product_of_its_steps():
    for a, b in itertools.product(range(6), range(6)):
        p, n = 1.0, [0, 0]
        for bit in [0] * a + [1] * b:
            p *= (n[bit] + 0.5) / (sum(n) + 1)
            n[bit] += 1
        assert ctw.log_estimate(np.array([float(a)]), np.array([float(b)]))[0] == pytest.approx(math.log(p), abs=1e-9)


@pytest.fixture(scope="module")
def judge(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return toxicity.train(docs, labels), docs, labels


def test_held_out_toxicity(judge):
    model, docs, labels = judge
    rows = toxicity.with_scores(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("toxic", "toxic_score").collect()
    good, bad = [[r.toxic_score for r in rows if r.toxic == k] for k in (0, 1)]
    above = np.mean([b > g for b in bad for g in good])
    assert above > 0.85 and np.mean([g < toxicity.THRESHOLD for g in good]) > 0.95


def test_a_misspelling_is_nearer_to_its_word_than_a_clean_text(judge):
    score = judge[0].scores(pa.array(["a pathetic looser", "you patthetic loserr", "the of and in that"]))
    assert score[0] > 0.3 and score[1] > 3 * score[2]


def test_scores_of_odd_rows(judge, odd):
    model = judge[0]
    rows = toxicity.with_scores(odd.withColumn("toxic_score", F.lit("clash")), model).collect()
    assert len(rows) == odd.count() and all(0 <= r.toxic_score <= 1 for r in rows)
    empty = {round(r.toxic_score, 9) for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1 and empty.pop() < toxicity.THRESHOLD
    assert toxicity.with_scores(odd.where("false"), model).count() == 0
    texts = pa.array([r.text for r in rows])
    assert np.allclose(model.scores(texts), [model.scores(texts[i : i + 1])[0] for i in range(len(texts))])


def test_each_class_has_its_share_of_the_bytes(spark, corpus):
    def sample(rows, most):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 7])], ["text", "toxic"]) for a in range(0, len(rows), 7)]
        texts, y = toxicity.within_bytes(iter(batches), most)
        assert list(zip(texts.to_pylist(), y.tolist())) == [r for r in rows if r in set(zip(texts.to_pylist(), y.tolist()))]
        return Counter(y.tolist())

    row = lambda i, k, n: (f"{i} ".ljust(n, "x"), k)
    late = [row(i, 0, 100) for i in range(100)] + [row(i, 1, 100) for i in range(100)]
    assert sample(late, 4000) == {0: 20, 1: 20}
    assert sample(late[:105], 4000) == {0: 35, 1: 5}
    assert sample([row(0, 0, 9000)] + late, 4000) == {0: 1, 1: 20}
    assert sample(late, 10**6) == {0: 100, 1: 100}
    assert sample([], 10) == {}

    # one long clean text used to fill the sample, so that no toxic row was learned from
    rows = [(i, f"awful nasty words {i}" if i % 2 else "the calm clean text " * 400) for i in range(400)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(400)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(corpus(rows), labels, most_bytes=5000)
    bad, good = model.scores(pa.array(["awful nasty words", "the calm clean text"]))
    assert bad > good


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 0, 1), (2, 0, None), (None, 1, 1)]])
def test_without_two_classes_all_get_the_share(spark, corpus, labels):
    docs = corpus([(1, "a b c"), (2, "d")])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert len(set(model.scores(pa.array(["a b c", "zzz", None])).round(9))) == 1
