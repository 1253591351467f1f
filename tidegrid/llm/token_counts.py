"""Token counts of texts through a cache of counts by digest.

Method: the digest of the normalised content and the digest of the tokenizer are joined to stored
counts; only distinct contents that the cache lacks are encoded, and their counts are appended to it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegrid.llm import words
from tidegrid.sources.tables import materialise

CACHE_SCHEMA = "digest binary, n_tokens bigint, tokenizer string"
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 1 << 20


# The split of a byte-level BPE file, and the letters that such a file writes for the bytes
# that have no printable letter of their own.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _as_ranks(path: str) -> dict[bytes, int] | None:
    """The merges of a plain byte-level BPE file as ranks; None if the file has anything else in it."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model.get("type", "BPE") == "BPE" and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    split = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
    if spec["normalizer"] or not plain or not split:
        return None
    others = (b for b in range(256) if b not in PRINTABLE)
    letters = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {token: i for token, i in model["vocab"].items() if token not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    if any(vocab.get(token) != 256 + i for i, token in enumerate(merged)) or len(vocab) != 256 + len(merged):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items()}


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts as the library of the file does.

    A text of Latin letters without one of the file's special strings goes through the same merges in
    tiktoken, which is several times faster; all others go through the file's own library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    ranks, fast = _as_ranks(path), None
    if ranks is not None:
        import tiktoken

        fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def count(texts: list[str]) -> list[int]:
        slow = [i for i, x in enumerate(texts) if fast is None or (not x.isascii() and max(x) >= "\u0250") or any(s in x for s in special)]
        found = dict(zip(slow, (len(e.ids) for e in own.encode_batch([texts[i] for i in slow], add_special_tokens=False))))
        return [found[i] if i in found else len(fast.encode_ordinary(x)) for i, x in enumerate(texts)]

    return count


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file never meets these counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def normalised(text: Column) -> Column:
    """The content as it is encoded: null is the empty text; anything else would change counts."""
    return F.coalesce(text, F.lit(""))


class TokenCache:
    """A parquet table of counts in a shared folder, one sub-folder for each tokenizer version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # an empty first part, so that the table can be read before anything is counted
        spark.range(0).selectExpr("binary('') digest", "0L n_tokens", "'none' tokenizer").write.mode("ignore").parquet(
            f"{path}/tokenizer=none"
        )

    def counts(self, version: str) -> DataFrame:
        stored = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).where(F.col("tokenizer") == version)
        # writers that ran at the same time may both have stored a content
        return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counted: DataFrame, version: str) -> None:
        counted.write.mode("append").parquet(f"{self.path}/tokenizer={version}")


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in words.chunks(batch, "text", ENCODE_BYTES):
                n = pa.array(count(part.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("digest"), n], ["digest", "n_tokens"])

    return encode


def token_counts(docs: DataFrame, path: str, cache: TokenCache, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text; others are ignored).

    Null text counts as empty (0 tokens).  Rows that repeat, ids that repeat or are null, and equal
    texts under different ids each keep their row; a text is encoded once however often it occurs.
    An empty table gives an empty result.  Long texts are encoded whole.

    Only ids and digests meet the cache; a text moves once, to be spread by the one row that stands
    for it, so a group of copies never gathers in a task.
    """
    version = tokenizer_version(path)
    content = normalised(F.col("text"))
    keyed = docs.select("doc_id", F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    misses = (
        keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(cache.counts(version), "digest", "left_anti")
    ).select(F.col("digest").alias("miss_digest"), F.col("doc_id").alias("miss_id"))
    texts = docs.select("doc_id", content.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    to_encode = texts.join(
        misses.hint("shuffle_hash"),
        (F.col("digest") == F.col("miss_digest")) & F.col("doc_id").eqNullSafe(F.col("miss_id")),
        "left_semi",
    ).select("digest", "text")
    cache.append(to_encode.mapInArrow(_encoder(path), "digest binary, n_tokens bigint"), version)
    # written once more, one narrow row a content: a join of two plain tables can split the rows of a hot digest
    return keyed.join(materialise(cache.counts(version)), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
