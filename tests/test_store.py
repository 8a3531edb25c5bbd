"""Stored postings: any order of batches, replays and compactions gives the batch result."""

import random
import re

import pytest

from spindex.operators import postings, search
from spindex.operators.store import PostingStore

SCHEMA = "token string, url string, count bigint"


def _table(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _expected(batches):
    total = {}
    for rows in batches:
        for t, u, n in rows:
            total[t, u] = total.get((t, u), 0) + n
    return total


def _heads(total, k):
    out = []
    for token in {t for t, _ in total}:
        own = sorted(((u, n) for (t, u), n in total.items() if t == token), key=lambda x: (-x[1], x[0]))
        out += [(token, u, n, i + 1) for i, (u, n) in enumerate(own[:k])]
    return sorted(out)


def _check(store, total):
    now = store.snapshot()
    assert _table(now.postings(), "token", "url", "count") == sorted((t, u, n) for (t, u), n in total.items())
    assert _table(now.heads(k=store.manifest()["head"]), "token", "url", "count", "word_rank") == _heads(total, now.head)
    df = {}
    for t, _ in total:
        df[t] = df.get(t, 0) + 1
    assert dict(_table(now.doc_frequency(), "token", "doc_freq")) == df
    stats = dict(_table(now.stats(), "metric", "value"))
    assert stats == {"tokens": len(df), "postings": len(total), "urls": len({u for _, u in total}),
                     "occurrences": sum(total.values())}


def test_any_interleaving(spark, tmp_path, seed=1):
    """Batches with old and new URLs, replays, compactions and vacuums in a random order; heads, document
    frequencies and statistics equal a full recompute after every step, ties by url."""
    rng = random.Random(seed)
    store = PostingStore.create(spark, str(tmp_path / "s"), buckets=4, head=3)
    _check(store, {})
    done = []
    for step in range(6):
        what = rng.choice(["add", "add", "replay", "compact"]) if step else "add"
        if what == "add":
            rows = [(rng.choice("abcde"), f"u{rng.randrange(8)}", rng.randrange(1, 4)) for _ in range(rng.randrange(12))]
            assert store.append(f"b{len(done)}", spark.createDataFrame(rows, SCHEMA))
            done.append(rows)
        elif what == "replay":
            i = rng.randrange(len(done))
            assert not store.append(f"b{i}", spark.createDataFrame(done[i], SCHEMA))
        else:
            several = len(store.manifest()["runs"]) > 1
            assert store.compact() == several
            store.vacuum()
        _check(store, _expected(done))
    reopened = PostingStore(spark, str(tmp_path / "s"))
    _check(reopened, _expected(done))


def test_reader_finishes_on_its_version(spark, tmp_path):
    store = PostingStore.create(spark, str(tmp_path / "s"), buckets=4)
    store.append("1", spark.createDataFrame([("a", "u", 1)], SCHEMA))
    store.append("2", spark.createDataFrame([("a", "u", 2)], SCHEMA))
    reader = store.snapshot().postings()          # planned, not yet run
    store.compact()
    store.append("3", spark.createDataFrame([("a", "u", 10)], SCHEMA))
    assert _table(reader, "token", "url", "count") == [("a", "u", 3)]
    assert _table(store.snapshot().postings(), "token", "url", "count") == [("a", "u", 13)]
    old = store.snapshot(2).postings()
    assert _table(old, "token", "url", "count") == [("a", "u", 3)]
    assert len(store.vacuum(keep=1)) == 2 and len(store.versions()) == 1
    assert _table(store.snapshot().postings(), "token", "url", "count") == [("a", "u", 13)]


def test_two_writers(spark, tmp_path):
    store = PostingStore.create(spark, str(tmp_path / "s"))
    now = store.manifest()
    store.append("1", spark.createDataFrame([("a", "u", 1)], SCHEMA))
    with pytest.raises(FileExistsError):
        store._commit(now["version"] + 1, now)
    with pytest.raises(ValueError):
        PostingStore.create(spark, store.path)
    with pytest.raises(ValueError):
        store.snapshot().heads(k=51)


def test_search_reads_only_the_tokens_buckets(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"t{rng.randrange(60)}", f"u{rng.randrange(30)}", rng.randrange(1, 9)) for _ in range(900)]
    flat = postings.merge_postings(spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA)).persist()
    store = PostingStore.create(spark, str(tmp_path / "s"), buckets=32, head=5)
    store.append("1", flat)
    tokens = spark.createDataFrame([("t1",), ("t2",)], "token string")
    for df in (store.snapshot().postings(tokens), store.snapshot().heads(tokens, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        read = re.search(r"PartitionFilters: \[(.*?)\], Pushed", plan)[1]
        assert "bucket" in read and re.search(r" IN \(\d+,\d+\)|bucket#\d+ = \d+", read)
    q = spark.createDataFrame([(1, "t1 t2"), (2, "t3 t3 t4 t5"), (3, "the of"), (4, "nowhere")], "query_id bigint, query string")
    for kw in ({"k": 5}, {"k": 3, "skip": 2}, {"k": 9}, {"k": 5, "scoring": "literal"}, {"k": 5, "require_all": True}):
        cols = ("query_id", "rank", "url", "score")
        assert _table(search.search(q, store.snapshot(), stem=False, **kw), *cols) == _table(
            search.search(q, flat, stem=False, **kw), *cols)


def test_keyset_pages(spark):
    rng = random.Random(6)
    rows = [(q, f"u{i:02d}", rng.randrange(5)) for q in (1, 2, 3) for i in range([0, 23, 7, 1][q])]
    ranked = spark.createDataFrame(rows, "query_id bigint, url string, score bigint")
    cursors = spark.createDataFrame([(1, None, None), (2, None, None)], "query_id bigint, score bigint, url string")
    got = {}
    for _ in range(5):
        page = search.page_after(ranked, cursors, 5)
        for r in sorted(page.collect(), key=lambda r: (r.query_id, -r.score, r.url)):
            got.setdefault(r.query_id, []).append((r.url, r.score))
        cursors = search.next_cursors(page).checkpoint()
    want = {q: sorted(((u, s) for i, u, s in rows if i == q), key=lambda x: (-x[1], x[0])) for q in (1, 2)}
    assert got == want
    assert search.page_after(ranked, cursors, 5).count() == 0
