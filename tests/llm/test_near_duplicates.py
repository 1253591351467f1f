import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import graph, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, size=5):
    found = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        found.setdefault(i, []).append(s)
    return found


def brute(rows, percent=80):
    """Least id reachable from each id, by comparing everything with everything."""
    flat = [(i, s) for i, many in sets_of(rows).items() if i is not None for s in many]
    label = {i: i for i, _ in flat}

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, (i, s) in enumerate(flat):
        for j, t in flat[a + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in label}


def assert_exact(rows, docs, percent=80):
    want, sets = brute(rows, percent), sets_of(rows)
    got = ngram_join.with_components(docs, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def near_copies(seed, groups, copies, length, changes, vocabulary=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(changes + 1)):
                text[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(text[: length - rng.randrange(4)]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [80, 60])
def test_groups_of_near_copies_at_the_edge(corpus, percent, monkeypatch):
    for name in ("PIVOTS", "BEST", "TRIES"):
        monkeypatch.setattr(ngram_join, name, 1)  # most links are then left to the last phase
    rows = near_copies(1, 6, 25, 80, 4) + [(1000 + i, t) for i, t in near_copies(2, 1, 60, 60, 5, 30)]
    assert_exact(rows, corpus(rows), percent)


@pytest.mark.parametrize("percent", [80, 60])
def test_long_lists_in_blocks_lose_no_link(corpus, percent, monkeypatch):
    for name in ("PIVOTS", "BEST", "TRIES"):
        monkeypatch.setattr(ngram_join, name, 1)
    monkeypatch.setattr(ngram_join, "SPLIT", 5)
    rows = near_copies(5, 2, 50, 80, 6)
    assert_exact(rows, corpus(rows), percent)


def test_pairs_of_a_list_come_in_bounded_batches(monkeypatch):
    n = 3000
    shape = np.full(n, 100 << 32)
    columns = [np.zeros(n, np.int64), np.arange(n), np.arange(n), np.ones(n, np.int64), shape]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["list", "doc", "label", "size", "shape"])
    sizes = [sum(len(p.as_py()) // 16 for p in b.column("partners")) for b in ngram_join._minor_rows(80)(iter([batch]))]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= ngram_join.BATCH + n


def test_partners_that_cannot_be_links_are_not_sent():
    sizes, places = [100, 100, 100, 10], [0, 20, 2, 0]
    columns = [[0] * 4, range(4), range(4), [1] * 4, [(a << 32) + (p << 2) for a, p in zip(sizes, places)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["list", "doc", "label", "size", "shape"])
    got = {(y, int(z)) for b in ngram_join._minor_rows(80)(iter([batch])) for y, p in zip(b["y"].to_pylist(), b["partners"]) for z in np.frombuffer(p.as_py(), np.int64)[::2]}
    assert got == {(0, 2)}


def test_documents_of_the_test_table(spark, corpus, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert_exact([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], docs)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert_exact(rows, odd)
    null_rows = [r for r in ngram_join.with_components(odd).collect() if r.doc_id is None]
    assert len(null_rows) == 2 and all(r.component_id is None for r in null_rows)
    assert ngram_join.with_components(odd.where("false")).count() == 0


def test_one_of_each_stays_once(corpus, odd):
    rows = near_copies(3, 3, 8, 50, 1) + [(100, "twice the same row here"), (100, "twice the same row here"), (None, "x"), (None, "x")]
    want = brute(rows)
    kept = ngram_join.one_of_each(corpus(rows))
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({want[i] for i, _ in rows if i is not None}) and ids.count(None) == 2
    assert kept.columns == odd.columns


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_edges(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    linked = {n for a, b in edges for n in (a, b) if a != b}
    assert got == {n: label[n] for n in linked}


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
