import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidegrid.llm import token_alignment
from tidegrid.llm.token_alignment import Alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE = Tokenizer.from_file(PATHS[0])
BYTE.encode_special_tokens = True
PIECE = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
SHOWN = {chr(b): b for b in token_alignment.PRINTABLE}
SHOWN |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in token_alignment.PRINTABLE)}


def ends(parts):
    return np.cumsum([len(p) for p in parts], dtype=np.int64)


def brute(rows):
    """Every pair of tokens tried for an overlap of bytes."""
    out, links = [], []
    for i, text in rows:
        a = BYTE.encode(f" {text or ''}", add_special_tokens=False).ids
        b = PIECE.encode(text or "")
        parts_a = [bytes(SHOWN[c] for c in BYTE.id_to_token(t)) for t in a]
        parts_b = [bytes([int(PIECE.id_to_piece(t)[3:5], 16)]) if PIECE.is_byte(t) else PIECE.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or b"".join(parts_a) != f" {text}".encode() or b"".join(parts_b) != f" {text}".encode():
            out.append([i, 0, 0, 0, 0, ""])
            links.append([])
            continue
        ea, eb = ends(parts_a).tolist(), ends(parts_b).tolist()
        cuts = sorted(set(ea) & set(eb))
        groups, u, v = [], 0, 0
        for c in cuts:
            x, y = ea.index(c) + 1, eb.index(c) + 1
            groups.append(",".join(map(str, a[u:x])) + "|" + ",".join(map(str, b[v:y])))
            u, v = x, y
        own = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if max(ea[x] - len(parts_a[x]), eb[y] - len(parts_b[y])) < min(ea[x], eb[y])]
        links.append(own)
        out.append([i, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    count = Counter(p for own in links for p in own)
    most = {}
    for (_, y), c in count.items():
        most[y] = max(most.get(y, 0), c)
    return sorted([(*o[:5], sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), o[5]) for o, own in zip(out, links)], key=str)


def result(docs):
    return sorted((tuple(r) for r in token_alignment.align(docs, *PATHS).collect()), key=str)


@pytest.mark.parametrize("seed", range(60))
def test_groups_and_links_of_any_ends(seed):
    rng = random.Random(seed)
    total = rng.randrange(1, 400)
    common, p = set(rng.sample(range(1, total + 1), rng.randrange(total))), rng.choice([0.0, 0.02, 0.5])
    sides = [np.array(sorted({*common, *(x for x in range(1, total) if rng.random() < p), total}), np.int64) for _ in range(2)]
    got = Alignment(*sides)
    merged = np.union1d(*sides)
    want = sorted(zip(np.searchsorted(sides[0], merged).tolist(), np.searchsorted(sides[1], merged).tolist()))
    assert sorted(zip(got.link_a.tolist(), got.link_b.tolist())) == want
    for side, opens in zip(sides, (got.opens_a, got.opens_b)):
        assert side[np.flatnonzero(opens)[1:] - 1].tolist() == np.intersect1d(*sides)[:-1].tolist()


def test_long_equal_stretches_are_jumped():
    ends_ = np.arange(1, 100_001, dtype=np.int64)
    other = np.delete(ends_, 50_000)
    assert Alignment(ends_, ends_).jumps == 1
    assert Alignment(ends_, other).jumps == 2


TEXTS = [
    "the quick brown fox", "the quick brown fox", "The thoned oren, ereth!", "naïve café élan ñandú", "日本語 text 漢字", "a<|endoftext|>b <s> </s> <unk> <0x41>",
    "  two  spaces\n\nand\tlines ", "▁ changes", "x" * 200, "\x00\x01 odd", "\U0001f600 \U0001f9d1‍\U0001f680", "́combining", "it's 12³ ½ ǅ",
]


def test_texts_of_all_kinds(spark, corpus):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id"), (None, "no id"), (50, None), (51, ""), (52, "   ")]
    assert result(corpus(rows)) == brute(rows)
    assert result(corpus(rows).where("false")) == []
    assert result(corpus([(1, None), (2, "")])) == brute([(1, None), (2, "")])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = docs.where("length(text) < 1500")
    assert result(short) == brute([(r.doc_id, r.text) for r in short.select("doc_id", "text").collect()])


def test_blocks_and_other_columns_do_not_matter(spark, corpus, monkeypatch):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)]
    docs = corpus(rows)
    for name in ("block", "documents", "pair", "count", "best", "found"):
        docs = docs.withColumn(name, docs.source)
    assert result(docs) == brute(rows)


def test_a_long_text(spark, corpus):
    (row,) = result(corpus([(1, "long " * 60_000)]))
    assert row[1] == len(BYTE.encode(" " + "long " * 60_000, add_special_tokens=False).ids) and row[2] == len(PIECE.encode("long " * 60_000))
