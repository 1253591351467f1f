import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidegrid.llm import periodic_runs, queries
from tidegrid.llm.periodic_runs import runs


def brute(w):
    """All runs (start, length, period) of a list of words, period by period."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(i, text):
    w = (text or "").encode().split()
    h = None if i is None else zlib.crc32(str(i).encode())
    if h is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]


def expected(i, text):
    w = planted(i, text)
    found = brute(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def result(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    return sorted((tuple(r[k] for k in names) for r in queries.QUERIES["op12_periodic_runs"](spark, "").collect()), key=str)


def repetitive(rng):
    k, w = rng.choice([1, 2, 2, 3, 5, 30]), []
    while len(w) < rng.randrange(0, 150):
        if rng.random() < 0.3:
            p = [rng.randrange(k) for _ in range(rng.randrange(1, 24))]
            w += (p * 9)[: rng.randrange(1, 8 * len(p))]
        else:
            w += [rng.randrange(k) for _ in range(rng.randrange(1, 20))]
    return w


@pytest.mark.parametrize("seed", range(100))
def test_runs_of_several_texts(seed):
    rng = random.Random(seed)
    texts = [repetitive(rng) for _ in range(rng.randrange(0, 6))]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, end, period = runs(np.array([x for t in texts for x in t], np.uint64), first)
    want = [(s + first[i], s + first[i] + n, q) for i, t in enumerate(texts) for s, n, q in brute(t)]
    assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want


def test_query_on_repetitive_texts(spark, corpus, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.randrange(400), rng.choice([" ", "\n", "  "]).join(f"é{x}" for x in repetitive(rng))) for _ in range(150)]
    assert result(spark, corpus(rows), monkeypatch) == sorted((expected(*r) for r in rows), key=str)


def test_query_on_whole_table(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 700]
    short = docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id bigint"), "doc_id", "left_semi")
    want = sorted((expected(*r) for r in rows), key=str)
    assert any(r[1] for r in want)
    assert result(spark, short, monkeypatch) == want


def test_odd_rows(spark, odd, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = result(spark, odd, monkeypatch)
    assert [r for r in got if r[0] != 8] == sorted((expected(*r) for r in rows if r[0] != 8), key=str)
    assert [r[:6] for r in got if r[0] == 8] == [(8, 1, 0, 60_000, 1, 60_000_000)]
    assert result(spark, odd.where("false"), monkeypatch) == []


def test_strongest_is_exact_and_takes_the_first_of_equals(spark):
    rows = [([(5, 9, 2), (7, 27, 6), (1, 12, 3)],), ([(3, 12, 3), (1, 8, 2)],), ([],)]
    df = spark.createDataFrame(rows, "runs array<struct<start: bigint, length: bigint, period: bigint>>")
    got = [r[0] for r in df.select(periodic_runs.strongest(df.runs)).collect()]
    assert [g and tuple(g) for g in got] == [(5, 9, 2), (3, 12, 3), None]
