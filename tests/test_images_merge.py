"""Image context climb, image postings, and the merge fixtures (FIXTURES.md)."""

from pyspark.sql import functions as F

from spindex.operators import images, merge, postings
from spindex.sources import tables


def _raw(spark, rows):
    data = [(u, h, 200, None, None, i) for i, (u, h) in enumerate(rows)]
    return tables.responses(spark.createDataFrame(data, tables.RAW_PAGES_SCHEMA))


def test_context_climbs_past_300_chars(spark):
    a, b, c = "a" * 20, "b" * 278, "c" * 1
    # text lengths after ' </' insertion: inner div 21, middle 300 (still climbs), outer 302
    html = (f"<html><body><div>{c}<div>{b}<div>{a}<img src='x.png' alt='pic'></div></div></div>"
            f"</body></html>")
    ctx = images.image_contexts(_raw(spark, [("http://h/p", html)])).collect()
    assert len(ctx) == 1
    lengths = len(ctx[0].context)
    assert lengths > 300 and ctx[0].context.startswith(c)


def test_context_falls_back_to_root(spark):
    html = "<html><head><title>T</title></head><body><p>short <img src='s.png'> text</p></body></html>"
    row = images.image_contexts(_raw(spark, [("http://h/q", html)])).first()
    assert "T" in row.context and "short" in row.context and "text" in row.context


def test_same_image_two_pages(spark):
    raw = _raw(spark, [("http://h/1", "<p>kitten <img src='i.png' alt='one'></p>"),
                       ("http://h/2", "<p>puppy <img src='i.png' alt='two'></p>")])
    ctx = images.image_contexts(raw)
    table = images.image_table(ctx).collect()
    assert [(r.url, r.alt, r.page_url) for r in table] == [("i.png", "one", "http://h/1")]
    post = {r.token for r in images.image_postings(ctx).collect()}
    assert {"kitten", "puppi", "one", "two"} <= post  # by the 1980 rules one -> on, a stop word


def test_image_rows_keep_tokens(spark):
    raw = _raw(spark, [("http://h/1", "<p>kittens <img src='i.png' alt='the one'></p>"),
                       ("http://h/2", "<p>puppies <img src='i.png' alt='two'> <img></p>")])
    ctx = images.image_contexts(raw)
    stemmed = {r.url: (r.page_url, list(r.tokens)) for r in images.image_table(ctx, keep_tokens=True).collect()}
    assert stemmed == {"i.png": ("http://h/1", ["kitten", "one"]), "": ("http://h/2", ["puppi"])}
    plain = {r.url: list(r.tokens) for r in images.image_table(ctx, keep_tokens=True, stem=False).collect()}
    assert plain == {"i.png": ["kittens", "one"], "": ["puppies"]}


def _pages(spark, rows):
    schema = "url string, title string, description string, urls array<string>, time timestamp, ingest_seq bigint"
    return spark.createDataFrame([(u, t, None, [], None, s) for u, t, s in rows], schema)


def test_stub_replaced_and_backlinks_united(spark):
    existing = _pages(spark, [("http://u", None, 1)])
    batch = _pages(spark, [("http://u", "T", 2)])
    merged = merge.merge_pages(existing, batch).collect()
    assert [(r.url, r.title) for r in merged] == [("http://u", "T")]
    bl = merge.merge_backlinks(spark.createDataFrame([("http://u", "a")], "url string, backlink string"),
                               spark.createDataFrame([("http://u", "b")], "url string, backlink string"))
    assert sorted(r.backlink for r in bl.collect()) == ["a", "b"]


def test_full_row_kept(spark):
    merged = merge.merge_pages(_pages(spark, [("http://u", "T1", 1)]), _pages(spark, [("http://u", "T2", 2)]))
    assert merged.first().title == "T1"


def test_link_only_makes_stub(spark):
    view = merge.page_view(_pages(spark, [("http://a", "A", 1)]).limit(0),
                           spark.createDataFrame([("http://u", "http://a")], "url string, backlink string"))
    r = view.first()
    assert (r.url, r.is_stub, r.n_backlinks) == ("http://u", True, 1)


def test_postings_upsert(spark):
    # ('t' itself is a stop word, so the fixture token is 'tok')
    existing = spark.createDataFrame([("tok", "u", 2)], "token string, url string, count bigint")
    delta1 = postings.term_counts(spark.createDataFrame([("u", "tok tok tok")], "url string, text string"),
                                  stem=False)
    got1 = {(r.token, r.url, r["count"]) for r in merge.upsert_postings(existing, delta1).collect()}
    assert got1 == {("tok", "u", 5)}
    delta2 = postings.term_counts(spark.createDataFrame([("v", "tok")], "url string, text string"), stem=False)
    got = {(r.token, r.url, r["count"]) for r in merge.upsert_postings(existing, delta2).collect()}
    assert got == {("tok", "u", 2), ("tok", "v", 1)}


def test_insert_ignore_first_wins(spark):
    a = spark.createDataFrame([("k", "old", 5)], "key string, v string, ingest_seq bigint")
    b = spark.createDataFrame([("k", "new", 1), ("j", "x", 3), ("j", "y", 2)], "key string, v string, ingest_seq bigint")
    got = {r.key: r.v for r in merge.insert_ignore(a, b, "key").collect()}
    assert got == {"k": "old", "j": "y"}
    assert F is not None


def test_stored_row_wins_over_earlier_numbered_batch(spark):
    merged = merge.merge_pages(_pages(spark, [("http://u", "OLD", 9)]), _pages(spark, [("http://u", "NEW", 3)]))
    assert [r.title for r in merged.collect()] == ["OLD"]


def test_left_out_end_tags(spark):
    html = f"<ul><li>one <img src='a.png'><li>two {'x' * 400}</ul>"
    row = images.image_contexts(_raw(spark, [("http://h/l", "<html><body>" + html)])).first()
    assert len(row.context) > 400        # the list itself, as the first item is short
    html = f"<table><tr><td>{'y' * 301}<img src='b.png'><td>second</table>"
    row = images.image_contexts(_raw(spark, [("http://h/t", "<html><body>" + html)])).first()
    assert row.context == "y" * 301


def test_nested_view_and_repeated_urls(spark):
    post = spark.range(12000).selectExpr("'tok' AS token", "concat('u', id) AS url", "1L AS count")
    assert [len(r.urls) for r in postings.nested_view(post).collect()] == [12000]
    parts = postings.nested_view(post, part_digits=1).collect()
    assert len(parts) == 16 and sum(len(r.urls) for r in parts) == 12000
    rows = spark.createDataFrame([("u", "cat fish"), ("u", "dog"), ("u", "dog"), (None, "cow")], "url string, text string")
    got = sorted((r.url or "", r.tokens) for r in postings.tokens_column(rows).collect())
    assert got == [("", ["cow"]), ("u", ["cat", "fish"]), ("u", ["dog"]), ("u", ["dog"])]


def test_result_page_lists_a_repeated_url_once(spark):
    from spindex.operators import search
    ranked = spark.createDataFrame([(1, 1, "u", 5)], "query_id long, rank long, url string, score long")
    got = search.results(ranked, _pages(spark, [("u", "T2", 2), ("u", "T1", 1)])).collect()
    assert [(r.title, r.n_results) for r in got] == [("T1", 1)]
