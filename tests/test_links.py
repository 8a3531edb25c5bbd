"""Link graph operators on a hand-made graph."""

from pyspark.sql import functions as F

from spindex.operators import links


def _graph(spark):
    pages = spark.createDataFrame(
        [("http://a", ["http://b", "http://c#x"]), ("http://b", ["http://c"]), ("http://c", ["http://d"])],
        "url string, urls array<string>")
    edges = (pages.select(F.col("url").alias("src"), F.posexplode("urls").alias("pos", "dst"))
             .withColumn("dst_key", F.substring_index("dst", "#", 1)))
    return pages, edges


def test_backlinks_and_degrees(spark):
    pages, edges = _graph(spark)
    bl = {(r.url, r.backlink) for r in links.backlinks(edges).collect()}
    assert bl == {("http://b", "http://a"), ("http://c", "http://a"), ("http://c", "http://b"),
                  ("http://d", "http://c")}
    deg = {r.url: (r.out_degree, r.in_degree) for r in links.degrees(pages, edges).collect()}
    assert deg == {"http://a": (2, 0), "http://b": (1, 1), "http://c": (1, 2)}
    assert [(r.url, r.n_backlinks) for r in links.stubs(pages, edges).collect()] == [("http://d", 1)]


def test_bfs_depth(spark):
    pages, edges = _graph(spark)
    depth = {r.url: r.depth for r in links.bfs_depth(pages, edges, max_depth=4).collect()}
    assert depth == {"http://a": 0, "http://b": 1, "http://c": 1, "http://d": 2}
    capped = {r.url: r.depth for r in links.bfs_depth(pages, edges, max_depth=1).collect()}
    assert capped == {"http://a": 0, "http://b": 1, "http://c": 1}


def test_frontier_scope(spark):
    pages, edges = _graph(spark)
    doms = spark.createDataFrame([("d",)], "domain string")
    assert [r.url for r in links.frontier(pages, edges, doms).collect()] == ["http://d"]
    assert [r.url for r in links.frontier(pages, edges, None).collect()] == ["http://d"]


def test_bfs_without_a_limit(spark):
    pages = spark.createDataFrame([(f"http://{i}", [f"http://{i + 1}"]) for i in range(7)], "url string, urls array<string>")
    edges = (pages.select(F.col("url").alias("src"), F.posexplode("urls").alias("pos", "dst"))
             .withColumn("dst_key", F.col("dst")))
    depth = {r.url: r.depth for r in links.bfs_depth(pages, edges).collect()}
    assert depth == {f"http://{i}": i for i in range(8)}
