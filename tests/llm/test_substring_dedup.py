import hashlib
import random
from collections import Counter

from tidegrid.llm import substring_dedup
from tidegrid.llm.substring_dedup import WINDOW


def brute(rows):
    split = [(substring_dedup.LAST if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for order, _, w in split:
        for k in range(len(w) - WINDOW + 1):
            s = tuple(w[k : k + WINDOW])
            first[s] = min(first.get(s, order), order)
    out = []
    for order, i, w in split:
        gone = {k + j for k in range(len(w) - WINDOW + 1) if first[tuple(w[k : k + WINDOW])] < order for j in range(WINDOW)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def result(docs):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.without_repeats(docs).collect())


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_odd_rows(spark, odd):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert result(odd.where("false")) == Counter()


def test_passages_copies_and_edges(spark, corpus):
    rng = random.Random(3)
    passage = prose(rng, 60)
    rows = []
    for i in range(60):
        w = prose(rng, rng.randrange(0, 120))
        if i % 3 == 0:
            k, a = rng.randrange(11, 60), rng.randrange(0, 10)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + k]
        rows.append((rng.choice([i, i, 7, None]), " ".join(w)))
    rows += [(i, rows[5][1]) for i in (200, 201, 202)] + [(3, " ".join(passage[:13])), (2, "\t".join(passage[:12])), (300, "a " * 100), (301, "a\n" * 14)]
    rng.shuffle(rows)
    assert result(corpus(rows)) == brute(rows)


def test_small_alphabets(spark, corpus):
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(rng.randrange(30), " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 80)))) for _ in range(60)]
        assert result(corpus(rows)) == brute(rows)


def test_small_packs_give_the_same(spark, corpus, monkeypatch):
    rng = random.Random(5)
    shared = prose(rng, 40)
    rows = [(i, " ".join(prose(rng, 30) + shared[: rng.randrange(40)] + prose(rng, 5))) for i in range(40)]
    before = result(corpus(rows))
    assert before == brute(rows)
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 64)
    assert result(corpus(rows)) == before


def test_lengths_double_until_none_is_left(spark, corpus):
    rng = random.Random(6)
    long = prose(rng, 1000, 10**6)
    rows = [(1, " ".join(long)), (2, " ".join(prose(rng, 9, 10**6) + long[50:950])), (3, " ".join(prose(rng, 500, 10**6)))]
    rows += [(4, " ".join(long[:20])), (5, rows[0][1])]
    found = {r.doc_id: r.longest for r in substring_dedup.without_repeats(corpus(rows)).collect()}
    # 900 shared words: seen at 832 = 13 * 64, which 900 exceeds by more than the spread
    assert found == {1: 0, 2: 832, 3: 0, 4: 13, 5: 1000}


def test_other_columns_do_not_matter(spark, corpus):
    docs = corpus([(1, "x y " * 10), (2, "x y " * 10)])
    for name in ("block", "kind", "pack", "copies", "h", "n_words"):
        docs = docs.withColumnRenamed("lang", name) if "lang" in docs.columns else docs.withColumn(name, docs.source)
    assert result(docs) == brute([(1, "x y " * 10), (2, "x y " * 10)])
