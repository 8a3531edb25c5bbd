"""Ranked lexical search against brute force, odd rows, pruning."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindex.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    """{item: [(id, score)]} by the definition."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = {}
    for i, ts in wanted.items():
        found = []
        for d, c in counted:
            m = 100 - 50 + (50 * c.total() * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in ts if t in c)
            if score > 0:
                found.append((d, score))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        if found:
            out[i] = found[:k]
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x1F600, exclude_categories=["Cs"]), max_size=40))
def test_terms(text):
    assert [t.decode() for t in lexical.split_terms(text)] == terms(text)


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    for name in ("id", "n", "terms", "tfs", "m", "ids", "score", "rank", "item", "term", "df"):
        d, q = d.withColumn(name, F.lit("extra")), q.withColumn(name, F.lit(1))
    return d, q


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        own = out.setdefault(r["item_id"], [])
        own.append((r["doc_id"], r["score"]))
        assert r["rank"] == len(own)
    return out


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "é", "日本", "x-y", "A_B", "don't"]
    some = lambda m: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(m))
    docs = [(i, some(rng.choice([1, 5, 20, 20, 20, 200]))) for i in range(n)]
    docs += [(1000 + i, "the same w1 w2 w3 text") for i in range(150)]  # a hot stratum of equal scores
    docs += [(None, "w1 w2"), (None, "w1 w2"), (5, "w1 again"), (7000, None), (7001, ""), (7002, "-- \n"), (7003, "w9 " * 30_000)]
    items = [(i, some(rng.randrange(1, 30))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere_else zzz"), (53, "w1 w2 w3"), (53, "w4 w1"), (None, "THE w50"), (54, "w9 " * 500)]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("block,vocabulary", [(1024, 1 << 25), (7, 1 << 25), (64, 0)])
def test_equals_brute_force(spark, block, vocabulary):
    docs, items = corpus()
    d, q = tables(spark, docs, items)
    before, lexical.BLOCK = lexical.BLOCK, block
    try:
        pairs = lexical.item_terms(q, "item_id", "text")
        wanted = None
        if vocabulary:
            wanted = spark.sparkContext.broadcast({r["term"].encode() for r in pairs.select("term").distinct().collect()})
        index = lexical.build(d, wanted=wanted, block=block)
        for k, group in ((50, 500_000), (3, 20)):
            assert results(lexical.search(index, pairs, k, group)) == brute(docs, items, k)
        assert results(lexical.rank(d, q, vocabulary=vocabulary)) == brute(docs, items)
    finally:
        lexical.BLOCK = before


def test_blocks_hold_one_stratum_and_bounds_prune(spark):
    docs, items = corpus(2, 3000)
    d, q = tables(spark, docs, items)
    index = lexical.build(d, block=32)
    assert index.blocks.where(F.size("ids") > 32).count() == 0
    assert index.blocks.count() > 40 and index.blocks.select("m").distinct().count() > 3
    assert index.blocks.select(F.sum(F.size("ids"))).first()[0] == len([1 for _, t in docs if terms(t)])
    visits = spark.sparkContext.accumulator(0)
    pairs = lexical.item_terms(q, "item_id", "text")
    got = results(lexical.search(index, pairs, 3, stats=visits))
    assert got == brute(docs, items, 3)
    assert visits.value < 0.8 * index.blocks.count() * len(got)


def test_impacts_of_large_frequencies():
    ids = pa.array([1, 2])
    row = lexical._invert(60, ids, pa.array([["b", "a"], ["a"]]), pa.array([[3, 10 ** 9], [2]], pa.list_(pa.int64())))
    row = {c: row.column(c)[0] for c in row.schema.names}
    block = lexical._Block({"m": 60, "ids": ids, "terms": row["terms"].values} | {c: row[c].as_buffer() for c in ("start", "tf", "doc")},
                           {"a": 0, "b": 1, "c": 2}, 3)
    import numpy as np
    got = block.scores(np.array([0, 1, 2]), np.array([5, 7, 9]))
    one = lambda tf: (10 ** 9 * tf) // (1000 * tf + 1200)
    assert got.tolist() == [5 * one(10 ** 9) + 7 * one(3), 5 * one(2)]
    assert block.most.tolist() == [one(10 ** 9), one(3), 0]


def test_empty_tables(spark):
    docs, items = corpus(3, 5)
    for a, b in (([], items), (docs, []), ([], []), ([(1, None)], [(1, None)])):
        d, q = tables(spark, a, b)
        out = lexical.rank(d, q)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
