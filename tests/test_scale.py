"""What lets the index build grow with its input: rows dealt to all tasks, each
text tokenised once, each batch computed once on its way into the store."""

from collections import Counter

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions import text
from spindex.operators import merge, postings, sizing
from spindex.operators.store import PostingStore
from spindex.plans import catalog
from spindex.session import checkpoint_dir
from spindex.sources import tables
from spindex.streaming import ingest


def counted(spark):
    """A function that gives its string back, and how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x
    return F.udf(same, "string").asNondeterministic(), calls


def per_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize("measured", [False, True])
def test_one_row_group_is_dealt_to_all_tasks(spark, tmp_path, monkeypatch, measured):
    path = str(tmp_path / "one.parquet")
    (spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path))
    monkeypatch.setattr(tables, "SPLIT_BYTES", 20_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # many splits, of which one has the rows
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > 4 and per_task(df) == [4000]
        got = tables.spread(df, None if measured else 280_000)
        tasks = per_task(got)
        assert len(tasks) >= 10 and tasks[-1] < 1000
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.collect()}
        assert got.columns == df.columns
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_spread_leaves_even_scans_and_takes_empty_ones(spark):
    even = spark.range(0, 1000, 1, 8).select(F.col("id").cast("string").alias("text"))
    assert per_task(tables.spread(even, 1)) == [125] * 8
    assert tables.spread(even.where("false"), 0).count() == 0


def test_texts_are_tokenised_once(spark):
    same, calls = counted(spark)
    texts = ["The cats and a cat", "", None, "  \n", "Café cats, running! running", "x"]
    corpus = spark.createDataFrame([("u%d" % (i % 5), t) for i, t in enumerate(texts)], "url string, text string")
    got = postings.term_counts(corpus.select("url", same("text").alias("text")), stem=True)
    assert {tuple(r) for r in got.collect()} == {("cat", "u0", 2), ("cat", "u4", 1), ("run", "u4", 2), ("x", "u0", 1)}
    assert calls.value == len(texts)


@pytest.mark.parametrize("summed", [False, True])
def test_a_batch_is_computed_once(spark, summed):
    same, calls = counted(spark)
    checkpoint_dir(spark)
    rows = [("t%d" % (i % 7), "u%d" % i, i) for i in range(50)]
    more = [] if summed else [("t0", "u0", 3)]
    delta = spark.createDataFrame(rows + more, "token string, url string, count long").withColumn("url", same("url"))
    store = PostingStore.create(spark, ingest.stream_folder(spark, "once"), buckets=4, head=3)
    assert store.append("1", delta, summed=summed)
    want = Counter()
    for t, u, c in rows + more:
        want[t, u] += c
    assert {(r.token, r.url): r["count"] for r in store.snapshot().postings().collect()} == want
    assert {(r.token, r.doc_freq) for r in store.snapshot().doc_frequency().collect()} == set(Counter(t for t, _ in want).items())
    assert calls.value == len(rows + more)


def test_spaced_words_are_those_of_the_tokeniser(spark):
    points = spark.range(0x110000).where("id < 55296 OR id > 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, F.lit("0"))), "UTF-32").alias("c"))
    apart = points.select(F.concat(F.lit("Ab"), "c", F.lit("cD ")).alias("t"))
    words = F.filter(F.split(text.spaced("t"), " "), lambda w: (w != "") & text.is_ascii(w))
    assert apart.where(~F.transform(words, F.lower).eqNullSafe(text.ascii_lower_words("t"))).count() == 0


@pytest.mark.parametrize("rows", [0, 1000])
def test_occurrences_are_not_shuffled_for_a_small_vocabulary(spark, monkeypatch, rows):
    monkeypatch.setattr(postings, "fits", lambda df: df.count() <= rows)
    corpus = spark.createDataFrame([("a", "The cats, a caté and\ta cat"), ("a", "Cats!"), ("b", None), (None, "cat dogs"), ("c", "of - the")],
                                   "url string, text string")
    got = postings.term_counts(corpus)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (rows > 0)
    assert {tuple(r) for r in got.collect()} == {("cat", "a", 3), ("cat", None, 1), ("dog", None, 1)}


def test_size_check_moves_no_rows(spark, monkeypatch):
    df = spark.range(0, 1000, 1, 8).select(F.col("id").cast("string").alias("token"))
    monkeypatch.setattr(DataFrame, "limit", lambda *a: pytest.fail("rows gathered in one task"))
    assert sizing.fits(df, 1000, 2890) and not sizing.fits(df, 999) and not sizing.fits(df, 1000, 2889)


def many_texts(spark, rows=400):
    """Texts of one task; "all" stands in each, three times."""
    words = F.concat_ws(" ", F.array(*[F.concat(F.lit(f"w{i}q"), F.col("id") % 50) for i in range(20)]))
    return spark.range(0, rows, 1, 1).select(F.concat(F.lit("u"), F.col("id")).alias("url"),
                                             F.concat(F.lit("zall zall zall "), words).alias("text"))


@pytest.mark.parametrize("stem", [False, True])
def test_counting_tasks_grow_with_the_texts(spark, monkeypatch, stem):
    monkeypatch.setattr(postings, "COUNT_BYTES", 2000)
    texts = many_texts(spark)
    odd = spark.createDataFrame([("u0", "zall"), (None, "zall zall"), ("v", None), ("v", "")], "url string, text string")
    got = postings.term_counts(texts.unionByName(odd), stem=stem)
    tasks = per_task(got)
    assert len(tasks) > 12 and tasks[-1] < sum(tasks) / 6
    want = Counter((r.token, r.url) for r in postings.occurrences(texts.unionByName(odd), stem=stem).collect())
    assert {(r.token, r.url): r["count"] for r in got.collect()} == want
    assert want["zall", "u0"] == 4 and want["zall", None] == 2


@pytest.mark.parametrize("mode", ["add", "skip"])
def test_recrawl_tasks_grow_with_the_texts(spark, mode):
    checkpoint_dir(spark)
    p = many_texts(spark).checkpoint()
    batch = p.where("url < 'u2'").unionByName(spark.createDataFrame([("new", "zall new"), (None, "zall")], "url string, text string")).checkpoint()
    counts = lambda df: postings.term_counts(df, stem=False, parts=24)
    want = Counter({(r.token, r.url): r["count"] for r in counts(p).collect()})
    for r in counts(batch).collect():
        if mode == "add" or r.url == "new":
            want[r.token, r.url] += r["count"]
    got = merge.recrawl(counts(p), p, batch, counts(batch), on_recrawl=mode, parts=24)
    tasks = per_task(got)
    assert len(tasks) > 12 and tasks[-1] < sum(tasks) / 6
    assert {(r.token, r.url): r["count"] for r in got.collect()} == want


def test_nested_lists_are_dealt_out_by_token_and_part(spark):
    post = postings.term_counts(many_texts(spark), stem=False, parts=8)
    got = postings.nested_view(post, part_digits=2, parts=24)
    tasks = per_task(got)
    assert len(tasks) > 12 and tasks[-1] < sum(tasks) / 6
    flat = lambda df: {(r.token, r.part, tuple(r.urls)) for r in df.collect()}
    assert flat(got) == flat(postings.nested_view(post, part_digits=2))


@pytest.mark.parametrize("query", ["m_recrawl_skip", "m_recrawl_add", "m_postings_upsert", "hx_term_counts", "scn_nested_index"])
def test_page_queries_deal_pairs_by_size(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr(postings, "COUNT_BYTES", 2000)
    (many_texts(spark).select(F.xxhash64("url").alias("page_id"), F.concat(F.lit("http://h/"), "url").alias("url"),
                              F.concat(F.lit("<html><body><p>"), "text", F.lit("</p></body></html>")).alias("html"))
     .write.parquet(str(tmp_path / "pages.parquet")))
    tasks = per_task(catalog.QUERIES[query](spark, str(tmp_path)))
    assert len(tasks) > 12 and tasks[-1] < sum(tasks) / 6
