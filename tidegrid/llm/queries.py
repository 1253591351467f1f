"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.llm import ctw, decontaminate, line_rules, mixing, ngram_join, periodic_runs, secret_scan, sharding, substring_dedup, token_alignment, token_counts, toxicity, warc
from tidegrid.sources.tables import read_table, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

N_SHARDS = 24
TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_sharding")
def _(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    content = F.coalesce("text", F.lit(""))
    sized = docs.withColumns({"size": (F.octet_length(content) + 8).cast("long"), "text_crc32": F.crc32(F.encode(content, "UTF-8"))})
    return sharding.with_shards(sized, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op2_ngram_join", ngram_join.SQL)
def _(spark, sf_dir):
    return ngram_join.with_components(read_table(spark, sf_dir, "documents"))


@query("op3_line_rules", line_rules.SQL)
def _(spark, sf_dir):
    judged = line_rules.with_line_rules(read_table(spark, sf_dir, "documents"))
    return judged.select(
        *"doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words n_lost_words base_failed kept".split()
    )


@query("op4_decontaminate")
def _(spark, sf_dir):
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op5_warc", warc.SQL)
def _(spark, sf_dir):
    files = warc.write(read_table(spark, sf_dir, "pages"), f"{shared_folder(spark)}-warc")
    return warc.read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_mixing", mixing.SQL)
def _(spark, sf_dir):
    mixed = mixing.with_copies(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op7_token_counts")
def _(spark, sf_dir):
    import public_tokenizers

    cache = token_counts.TokenCache(spark, f"{shared_folder(spark)}-token-cache")
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache)


@query("op8_secret_scan")
def _(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs)).drop("redacted")


@query("op9_toxicity")
def _(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op10_context_tree")
def _(spark, sf_dir):
    return ctw.lm_scores(read_table(spark, sf_dir, "documents"))


@query("op13_substring_dedup", substring_dedup.SQL)
def _(spark, sf_dir):
    return substring_dedup.without_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op12_periodic_runs")
def _(spark, sf_dir):
    found = periodic_runs.find_runs(periodic_runs.with_planted_runs(read_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op11_token_alignment")
def _(spark, sf_dir):
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(read_table(spark, sf_dir, "documents"), *paths)
