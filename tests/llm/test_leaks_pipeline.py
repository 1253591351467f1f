import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import decontaminate, mixing, queries
from tidegrid.session import ship_package

from test_near_duplicates import brute


def words(rng, n, vocabulary=3000):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark, corpus):
    rng = random.Random(4)
    items = [words(rng, rng.randrange(15, 60)) for _ in range(40)] + [words(rng, 300)]
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, " \n")], "item_id bigint, text string")
    rows, want = [], set()
    for i in range(300):
        text = words(rng, rng.randrange(20, 400))
        at = rng.randrange(len(text))
        item = items[i % len(items)]
        if i % 3 == 0:  # as it is, or in capitals with other marks
            piece = item if i % 2 else [f"{w.upper()}," for w in item]
        elif i % 3 == 1:  # a paraphrase: every sixth word is another one
            piece = [w if k % 6 else "other" for k, w in enumerate(item)]
        else:
            piece = rng.sample(item, 5)
        if i % 3 < 2:
            want.add((i, i % len(items)))
        rows.append((i, " ".join(text[:at] + piece + text[at:])))
    return corpus(rows), benchmark, want


def test_copies_and_paraphrases_are_found_and_clean_texts_left(planted):
    docs, benchmark, want = planted
    rows = decontaminate.leaks(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got) == len(rows)
    assert got <= want and len(got & want) >= 0.97 * len(want)
    exact = {k for k in want if k[0] % 3 == 0}
    assert exact <= got


def test_a_large_benchmark_hides_no_copy(spark, corpus):
    rng = random.Random(8)
    items = [" ".join(words(rng, 64)) for _ in range(1100)]
    docs = corpus([(i, f"before it {t} and after") for i, t in enumerate(items)])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()} == {(i, i) for i in range(1100)}


def test_widespread_passages_and_common_words_are_found(spark, corpus):
    rng = random.Random(9)
    common = [f"common{i}" for i in range(30)]
    spread, usual = words(rng, 40), rng.sample(common, 30)
    rows, want = [], set()
    for i in range(600):
        piece = spread if i % 3 == 0 else usual if i % 50 == 1 else rng.sample(common, 30)
        want |= {(i, 0)} if i % 3 == 0 else {(i, 1)} if i % 50 == 1 else set()
        rows.append((i, " ".join(words(rng, 30) + piece + words(rng, 30))))
    benchmark = spark.createDataFrame([(0, " ".join(spread)), (1, " ".join(usual))], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(corpus(rows), benchmark).collect()} == want


def test_candidate_search_against_all_windows(planted):
    """Recall of the latent cosine: pairs that a subsequence over the whole text would find."""
    docs, benchmark, _ = planted
    block = next(decontaminate.blocks(docs.select("doc_id", decontaminate.plain(F.col("text")).alias("text")), benchmark))
    import pyarrow as pa

    found, all_pairs = 0, 0
    texts = docs.select(decontaminate.plain(F.col("text"))).limit(100).toPandas().iloc[:, 0]
    for text in texts:
        w, first = decontaminate._hashed(pa.array([text]))
        near = set(decontaminate.candidates(block, w, first)[3].tolist())
        for i, mine in enumerate(block.words):
            if decontaminate.subsequence(mine[:, None] == w[None]) >= decontaminate.COPY * len(mine):
                all_pairs += 1
                found += i in near
    assert all_pairs > 50 and found >= 0.95 * all_pairs


def test_subsequence():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.subsequence(a[:, None] == b[None]) == best[-1][-1]


def test_odd_rows(odd, planted, spark):
    docs, benchmark, _ = planted
    text = benchmark.where("item_id = 3").first().text
    more = odd.unionByName(spark.createDataFrame([(50, text, None, None, 0), (50, text, None, None, 0), (None, text, None, None, 0)], odd.schema))
    rows = decontaminate.leaks(more.withColumn("item_id", F.lit("clash")), benchmark).collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) == Counter({(50, 3): 1, (None, 3): 1})
    kept = decontaminate.without_leaks(more, benchmark)
    assert kept.columns == more.columns and kept.count() == odd.count() + 1
    assert decontaminate.leaks(odd.where("false"), benchmark).count() == 0
    assert decontaminate.leaks(odd, benchmark.where("false")).count() == 0
    assert decontaminate.leaks(odd, benchmark.where("item_id >= 90")).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of every stage, as rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.materialise(stage(spark, steps[-1], sf)))
    return steps


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_each_stage_does_its_part_of_the_job(spark, sf, stages):
    docs, clean, single, safe, mixed, dealt = stages
    for df in stages[:-1]:
        assert df.columns == docs.columns
    assert dealt.columns == [*docs.columns, "shard", "slot"]

    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op9_toxicity"](spark, sf).collect()}
    assert ids(clean) == Counter(i for i, p in scores.items() if p == 0)

    least = brute([(r.doc_id, r.text) for r in clean.collect()])
    assert ids(single) == Counter(set(least.values()))

    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    has = lambda text: any(t.text.lower() in text.lower() for t in items)
    gone = ids(single) - ids(safe)
    assert {r.doc_id for r in single.collect() if has(r.text)} <= set(gone)
    grams = {g for t in items for g in zip(*[t.text.lower().split()[k:] for k in range(4)])}
    for r in single.where(F.col("doc_id").isin(list(gone))).collect():
        assert sum(g in grams for g in zip(*[r.text.lower().split()[k:] for k in range(4)])) >= 5

    copies = {r.doc_id: r.copies for r in mixing.with_copies(safe).collect()}
    assert ids(mixed) == Counter({i: n for i, n in copies.items() if n})

    assert ids(dealt) == ids(mixed)
    held = Counter(r.shard for r in dealt.collect())
    assert len(held) == corpus_pipeline.N_SHARDS and max(held.values()) - min(held.values()) <= 1


def test_run_gives_the_last_stage(spark, sf, stages):
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, stages[-1].select("doc_id", "shard", "slot").collect()))


def test_an_empty_corpus_runs_through(spark, sf, odd):
    ship_package(spark)
    df = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.materialise(stage(spark, df, sf))
    assert df.count() == 0


def test_odd_rows_run_through(spark, sf, odd):
    df = odd
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.materialise(stage(spark, df, sf))
    texts = {r.text for r in df.collect()}
    assert re.compile("long").match(max(texts, key=lambda t: len(t or "")))


def test_columns_of_any_name_come_through(spark, sf, odd):
    names = "mix_source size target copies row drop_id again_id ring_cell ring_held toxic_score item_id label x text_ block".split()
    docs = odd.withColumns({n: F.concat(F.lit(n), F.xxhash64("doc_id", "text")) for n in names})
    df = docs
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.materialise(stage(spark, df, sf))
    rows = df.collect()
    assert len(rows) > 5 and df.columns == [*docs.columns, "shard", "slot"]
    before = {tuple(r) for r in docs.collect()}
    assert {tuple(r)[: len(docs.columns)] for r in rows} <= before


def test_frequencies_count_texts_in_small_parts(monkeypatch):
    """A counter rises once a text, and no more text than a scan holds is made into arrays at a time."""
    import zlib

    import numpy as np
    import pyarrow as pa

    from tidegrid.llm import decontaminate, words

    limits, chunks = [], words.chunks
    monkeypatch.setattr(words, "chunks", lambda batch, text, limit=words.CHUNK_BYTES: limits.append(limit) or chunks(batch, text, limit))
    texts = ["a b a b a", "", "b c", None, "a " * 200_000, "c"]
    out = list(decontaminate._frequencies(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})])))[0].to_pydict()
    counts = np.concatenate([np.frombuffer(zlib.decompress(b), np.int32) for b in out["blob"]])
    of = {w: decontaminate._counter(decontaminate._hashed(pa.array([w]))[0])[0] for w in "abc"}
    assert [counts[of[w]] for w in "abc"] == [2, 2, 2] and counts.sum() == 6 and sum(out["rows"]) == 6
    assert limits and max(limits) <= decontaminate.SCAN_BYTES


def test_punctuation_is_space_wherever_texts_become_words():
    import pyarrow as pa

    (got, ends), (want, _) = (decontaminate._hashed(pa.array([t])) for t in ("a.b,(c)#d é`ü<x>~", " a b c d é ü x "))
    assert got.tolist() == want.tolist() and ends.tolist() == [0, 7]
