import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tidegrid.llm import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet="aB cé\n\t\x0b\U0001f600 ", max_size=40), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    data, offsets = words.text_bytes(pa.array(texts, pa.string()))
    found = words.Words(data, offsets, lower=True)
    got = [bytes(found.data[a:b]).decode() for a, b in zip(found.start, found.end)]
    want = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t)] for t in texts]
    assert got == [w for ws in want for w in ws]
    assert list(found.counts()) == [len(w) for w in want]
    h = found.hashes()
    assert len(set(got)) == len(set(h.tolist()))


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_equal_shingles_have_equal_hashes_and_no_others(texts):
    data, offsets = words.text_bytes(pa.array(texts, pa.string()))
    hashes, first = words.shingles(words.Words(data, offsets), 3)
    want = []
    for t in texts:
        w = WORD.findall(t)
        want += [tuple(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([tuple(w)] if w else [])
    assert len(want) == len(hashes)
    assert len(set(want)) == len(set(hashes.tolist())) == len(set(zip(want, hashes.tolist())))


def test_chunks_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 40, 1, 1, 90, 2)] + [None])], ["text"])
    parts = list(words.chunks(batch, "text", 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert len(parts) > 3


def test_slices_of_a_column_are_read_from_their_own_offset():
    column = pa.array(["xx yy", "zz", None, "q"])[1:]
    data, offsets = words.text_bytes(column)
    assert bytes(data) == b"zzq" and list(offsets) == [0, 2, 2, 3]
    assert np.array_equal(words.Words(data, offsets).counts(), [1, 0, 1])
