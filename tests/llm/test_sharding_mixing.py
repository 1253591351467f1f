from collections import Counter

import pytest
from pyspark.sql import functions as F

import oracle
from tidegrid.llm import mixing, queries, sharding


def test_counts_are_one_apart_and_slots_gapless(spark, sf):
    rows = queries.QUERIES["op1_sharding"](spark, sf).collect()
    held = Counter(r.shard for r in rows)
    assert set(held) == set(range(24)) and max(held.values()) - min(held.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(24) for i in range(held[s])]
    assert {r.law for r in rows} == {"rows"} and len({r.doc_id for r in rows}) == len(rows)


def one_by_one(counts, shards, slack):
    """The same rounds, one key at a time."""
    around = sharding.ring(shards, 8, 64)
    owner = [min((i for i, (c, _) in enumerate(around) if c >= cell), default=0) for cell in range(64)]
    keys = [(cell, r) for cell in sorted(counts) for r in range(counts[cell])]
    demand = [0] * shards
    for cell, _ in keys:
        demand[around[owner[cell]][1]] += 1
    most, held, out = sharding.bounds(demand, slack), Counter(), {}
    waiting = [(owner[cell], cell, r) for cell, r in keys]
    while waiting:
        left = []
        for node, cell, r in sorted(waiting):
            s = around[node][1]
            if held[s] < most[s]:
                held[s] += 1
                out[cell, r] = s
            else:
                left.append((node, cell, r))
        waiting = []
        for node, cell, r in left:
            node = (node + 1) % len(around)
            while held[around[node][1]] >= most[around[node][1]]:
                node = (node + 1) % len(around)
            waiting.append((node, cell, r))
    return out


@pytest.mark.parametrize("slack", [0.0, 0.1, 5.0])
def test_walk_is_that_of_single_keys(slack):
    counts = {c: (c * 7919) % 13 for c in range(64)}
    got = {}
    for cell, lo, hi, shard, _ in sharding.walk(counts, 5, 8, 64, slack):
        for r in range(lo, hi):
            got[cell, r] = shard
    assert got == one_by_one(counts, 5, slack)


def test_one_more_shard_moves_few_with_slack(corpus):
    docs = corpus([f"text {i}" for i in range(4000)])
    a = dict(sharding.with_shards(docs, 10, slack=0.3).select("doc_id", "shard").collect())
    b = dict(sharding.with_shards(docs, 11, slack=0.3).select("doc_id", "shard").collect())
    assert sum(a[i] != b[i] for i in a) < 0.25 * len(a)
    assert max(Counter(a.values()).values()) <= 1.3 * 400 + 1


def test_odd_rows_keep_their_place_and_columns(odd):
    docs = odd.withColumn("shard", F.lit("clash")).withColumn("extra", F.lit(1))
    out = sharding.with_shards(docs, 3)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns == [*odd.columns, "extra", "shard", "slot"]
    assert sorted((r.shard, r.slot) for r in rows)[0] == (0, 0)
    again = sharding.with_shards(docs.repartition(7), 3).collect()
    key = lambda r: (str(r.doc_id), str(r.text)[:20], r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sharding.with_shards(docs.where("false"), 3).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, sf, name):
    from tidegrid.session import ship_package

    ship_package(spark)
    got, columns = oracle.spark_rows(queries.QUERIES[name](spark, sf))
    want, wanted = oracle.duck_rows(oracle.connect(sf), queries.ORACLES[name])
    assert columns == wanted and got == want


def test_targets_stop_at_three_times_the_source(corpus):
    texts = [(i, "w " * n) for i, n in enumerate((10, 100, 5000, 0))]
    docs = corpus(texts, {0: "a", 1: "b", 2: "c", 3: None})
    rows = {r.doc_id: r for r in mixing.with_copies(docs).collect()}
    assert [rows[i].target for i in range(4)] == [30.0, 300.0, 4780.0, 0.0]
    assert rows[0].copies == rows[1].copies == 3 and rows[2].copies in (0, 1) and rows[3].copies == 0


def test_mixture_repeats_and_draws_alike_again(odd):
    clash = odd.withColumn("copies", F.lit(9))
    rated = mixing.with_copies(clash)
    assert rated.count() == odd.count()
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert out.count() == rated.agg(F.sum("copies")).first()[0]
    again = mixing.with_copies(odd.repartition(5)).select("doc_id", "text", "copies")
    assert again.exceptAll(rated.select("doc_id", "text", "copies")).count() == 0
    assert mixing.mix(odd.where("false")).count() == 0
