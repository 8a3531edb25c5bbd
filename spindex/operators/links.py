"""Link graph and crawl frontier (LG1-LG9).

Input is the edge list of ``pages.link_edges``: (src, dst, dst_key, pos),
where ``dst_key`` is the fragment-free target (UR2) and fetched pages are
keyed the same way (``page_key``), so a backlink to a page fetched as
``...#top`` finds that page.

Backlinks are kept **flat** -- one row per (url, backlink) -- because a
popular page can be linked from a large share of the corpus; in-degrees are
counted from the distinct edges with a combinable count, so a hot target
never gathers its backlinks into one task.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..session import checkpoint_dir


def page_key(url_col: str = "url"):
    """Key of a fetched page in the link graph (UR2 of its stored URL)."""
    return urls.remove_fragments(url_col)


def backlinks(edges: DataFrame) -> DataFrame:
    """LG1: the set of pages linking to each URL, flat: (url, backlink)."""
    return edges.select(F.col("dst_key").alias("url"), F.col("src").alias("backlink")).distinct()


def referrer_backlinks(raw: DataFrame) -> DataFrame:
    """LG1, the referrer route: responses that name the page they were reached
    from give a (url, backlink) pair as well; both ends are formatted, and the
    URL loses its fragment."""
    return (raw.filter(F.col("referrer").isNotNull() & (F.col("referrer") != ""))
            .select(urls.remove_fragments("url").alias("url"), urls.format_url("referrer").alias("backlink")).distinct())


def in_degree(edges: DataFrame) -> DataFrame:
    """LG4 (in): number of distinct pages linking to each URL."""
    return backlinks(edges).groupBy("url").agg(F.count(F.lit(1)).alias("in_degree"))


def degrees(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """LG4: out-degree (size of the stored link list) and in-degree of each
    fetched page."""
    ind = in_degree(edges).withColumnRenamed("url", "_key")
    p = pages.select("url", F.size("urls").cast("bigint").alias("out_degree"),
                     page_key("url").alias("_key"))
    return (p.join(ind, "_key", "left")
            .select("url", "out_degree", F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree")))


def stubs(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """LG2: URLs known only from links (no fetched page): (url, n_backlinks).
    These are the rows the reference creates by upsert with backlinks only."""
    fetched = pages.select(page_key("url").alias("url")).distinct()
    return (in_degree(edges).join(fetched, "url", "left_anti")
            .withColumnRenamed("in_degree", "n_backlinks"))


def canonical(u: str):
    """LG5: request identity -- fragment dropped, query parameters sorted."""
    base = F.substring_index(F.col(u), "#", 1)
    path = F.substring_index(base, "?", 1)
    query = F.when(base.contains("?"), F.expr(f"substr(substring_index({u}, '#', 1), "
                                               f"instr(substring_index({u}, '#', 1), '?') + 1)"))
    params = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.when(query.isNull() | (query == ""), path).otherwise(F.concat(path, F.lit("?"), params))


def seen(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """LG5: each edge with a flag telling whether its target was already
    fetched under the same request identity."""
    fetched = pages.select(canonical("url").alias("_canon")).distinct().withColumn("seen", F.lit(True))
    return (edges.withColumn("_canon", canonical("dst"))
            .join(fetched, "_canon", "left")
            .select("src", "pos", "dst", F.coalesce("seen", F.lit(False)).alias("seen")))


def frontier(pages: DataFrame, edges: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """LG6: distinct discovered targets, in scope (UR5), not yet fetched."""
    fetched = pages.select(canonical("url").alias("_canon")).distinct()
    cand = edges.select(F.col("dst").alias("url")).distinct()
    scoped = urls.in_scope(cand, "url", domains, ("url",))
    return (scoped.withColumn("_canon", canonical("url"))
            .join(fetched, "_canon", "left_anti").select("url"))


def bfs_depth(pages: DataFrame, edges: DataFrame, seeds: DataFrame | None = None,
              max_depth: int | None = None) -> DataFrame:
    """LG7/LG8: breadth-first depth of every node reachable from the seeds.

    Seeds default to the fetched pages no other fetched page links to.  Each
    level is one join of the frontier with the edges and one anti join with
    the levels before it.  A level is written once (checkpointed to the shared
    folder) and never again, so the work written is one row per node, and the
    lineage stays one level deep.  The loop stops when a level adds nothing, or
    at ``max_depth`` when one is given (LG8); the only driver action per level
    is the emptiness test of the new frontier.  The edges are written once, so
    no level derives them again.  For a graph that grows see ``crawl_depth``."""
    checkpoint_dir(pages.sparkSession)
    e = edges.select(page_key("src").alias("node"), F.col("dst_key").alias("next")).distinct().checkpoint()
    if seeds is None:
        keys = pages.select(page_key("url").alias("node")).distinct()
        linked = e.select(F.col("next").alias("node")).join(keys, "node", "left_semi").distinct()
        seeds = keys.join(linked, "node", "left_anti")
    level = visited = seeds.select("node", F.lit(0).alias("depth")).distinct().checkpoint()
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        level = (level.join(e, "node").select(F.col("next").alias("node")).distinct()
                 .join(visited.select("node"), "node", "left_anti")
                 .select("node", F.lit(d).alias("depth"))).checkpoint()
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited.select(F.col("node").alias("url"), F.col("depth").cast("int").alias("depth"))


def depth_counts(depths: DataFrame) -> DataFrame:
    """LG9: number of nodes per BFS depth."""
    return depths.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
