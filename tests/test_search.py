"""Search scoring on the FIXTURES.md postings: cat {p1:5, p2:3}, dog {p1:1, p3:4}."""

import pytest

from spindex.operators import search


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([("cat", "p1", 5), ("cat", "p2", 3), ("dog", "p1", 1), ("dog", "p3", 4)],
                                 "token string, url string, count bigint")


def _run(spark, index, query, **kw):
    q = spark.createDataFrame([(1, query)], "query_id bigint, query string")
    rows = search.search(q, index, stem=False, **kw).orderBy("rank").collect()
    return [(r.url, r.score) for r in rows]


@pytest.mark.parametrize("query,expected", [
    ("cat", [("p1", 5), ("p2", 3)]),
    ("cat dog", [("p1", 6), ("p3", 4), ("p2", 3)]),
    ("dog cat", [("p1", 6), ("p3", 4), ("p2", 3)]),
    ("cat cat", [("p1", 5), ("p2", 3)]),
    ("the of", []),
    ("zebra", []),
])
def test_sum(spark, index, query, expected):
    assert _run(spark, index, query) == expected


@pytest.mark.parametrize("query,expected", [
    ("cat dog", [("p1", 10), ("p3", 4), ("p2", 3)]),
    ("dog cat", [("p3", 4), ("p2", 3), ("p1", 2)]),
])
def test_literal(spark, index, query, expected):
    assert _run(spark, index, query, scoring="literal") == expected


def test_require_all(spark, index):
    assert _run(spark, index, "cat dog", require_all=True) == [("p1", 6)]


def test_topk_cut(spark, index):
    assert _run(spark, index, "cat", k=1) == [("p1", 5)]


def test_results_presentation(spark, index):
    pages = spark.createDataFrame([("p1", "", "d" * 250), ("p2", "T", ""), ("p3", None, None)],
                                  "url string, title string, description string")
    q = spark.createDataFrame([(1, "cat dog")], "query_id bigint, query string")
    res = search.results(search.search(q, index, stem=False), pages).orderBy("rank").collect()
    assert [(r.url, r.title, r.rank, r.n_results) for r in res] == [
        ("p1", "No title available", 1, 2), ("p2", "T", 2, 2)]
    assert res[0].description == "d" * 200 + "..."
    assert res[1].description == "No description available"


def test_no_broadcast_fallback(spark, index, monkeypatch):
    """Above the size bound the query tokens and candidate URLs are joined by
    the planner's shuffle join; the results must not change."""
    from spindex.operators import sizing
    cases = [(q, s) for q in ("cat dog", "dog cat") for s in ("sum", "literal")]
    expected = {c: _run(spark, index, c[0], scoring=c[1]) for c in cases}
    refused = []
    monkeypatch.setattr(search, "broadcast_if_small",
                        lambda df, max_rows=0: refused.append(1) or sizing.broadcast_if_small(df, 0))
    for q, s in cases:
        assert _run(spark, index, q, scoring=s) == expected[(q, s)]
    assert refused
