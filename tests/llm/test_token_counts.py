import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidegrid.llm import token_counts
from tidegrid.sources.tables import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_every_row_as_the_library_counts(spark, odd):
    cache = token_counts.TokenCache(spark, shared_folder(spark))
    rows = token_counts.token_counts(odd, PATH, cache).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), by_library(r.text)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts.token_counts(odd.where("false"), PATH, cache).count() == 0


def test_only_distinct_misses_are_encoded_and_kept(spark, corpus):
    cache = token_counts.TokenCache(spark, shared_folder(spark))
    stored = lambda: spark.read.parquet(cache.path).where("tokenizer <> 'none'").count()
    token_counts.token_counts(corpus(["a b", "a b", "c", None, ""]), PATH, cache)
    assert stored() == 3
    rows = token_counts.token_counts(corpus(["c", "a b", "new"]), PATH, cache).collect()
    assert stored() == 4 and {r.doc_id: r.n_tokens for r in rows} == {0: by_library("c"), 1: by_library("a b"), 2: by_library("new")}


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b", "日本語 text", "́​", "x" * 3000, "  \n\n  ", "it's 12³ ½", "ǅ ß"])
def test_special_strings_and_scripts(text):
    assert token_counts.counter(PATH)([text]) == [by_library(text)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert token_counts.counter(PATH)([text]) == [by_library(text)]
