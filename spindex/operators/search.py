"""Batch keyword search over the flat postings table (SE1-SE11).

A table of queries is answered in one plan:

    queries -> analyse (same tokeniser as pages)             SE1
      -> postings semi-joined to the query tokens            (index lookup)
      -> top ``k`` postings per token, count desc, url asc    SE2, SE9
      -> candidates = distinct (query, url) of those          SE3
      -> all postings of candidate URLs and query words       SE4
      -> score (sum or the reference's literal rule)          SE5, SE5b
      -> rank per query, score desc, url asc                  SE6
      -> join non-stub pages, presentation columns            SE7, SE8

The analysed queries and the top-k postings are bounded (queries x words,
tokens x k) and are checkpointed, so the size checks and the plan's branches
read them instead of re-running the tokeniser or the top-k job.

The top-k is ranked per *token*, not per (query, token): a token shared by
many queries is ranked once.  The query tokens are broadcast (after a size
check) into the postings scan, so the postings are not shuffled for the
lookup; the window's own shuffle then gets a partial group limit that keeps
only ``k`` rows per token in each map task, so a hot token ships at most
``k`` rows per task and its final ranking task stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import checkpoint_dir
from . import postings as P
from .sizing import broadcast_if_small
from .store import Snapshot

PER_WORD_LIMIT = 50   # fixed value: postings kept per query word
PER_WORD_SKIP = 0     # fixed value: postings skipped per query word


def analyze(queries: DataFrame, stem: bool = True, id_col: str = "query_id",
            text_col: str = "query") -> DataFrame:
    """SE1: (query_id, token, qpos) -- each distinct token once, at its first
    position in the query.  No tokens -> no rows (empty result)."""
    if stem:
        occ = P.occurrences(queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("q")),
                            stem=True, key="query_id", text_col="q")
    else:
        occ = queries.select(F.col(id_col).alias("query_id"),
                             F.posexplode_outer(text.tokens(text_col)).alias("pos", "token")
                             ).filter(F.col("token").isNotNull())
    return occ.groupBy("query_id", "token").agg(F.min("pos").alias("qpos"))


def top_postings(postings: DataFrame, tokens: DataFrame, k: int = PER_WORD_LIMIT,
                 skip: int = PER_WORD_SKIP) -> DataFrame:
    """SE2: for each wanted token its postings ranked by count desc, url asc,
    keeping ranks ``skip+1 .. skip+k``."""
    wanted = broadcast_if_small(tokens.select("token").distinct())
    return _top_k(postings.join(wanted, "token", "left_semi"), k, skip)


def _top_k(postings: DataFrame, k: int, skip: int) -> DataFrame:
    w = Window.partitionBy("token").orderBy(F.desc("count"), F.asc("url"))
    return (postings.withColumn("word_rank", F.row_number().over(w))
            .filter((F.col("word_rank") > skip) & (F.col("word_rank") <= skip + k)))


def score(queries_analyzed: DataFrame, postings: DataFrame | Snapshot, k: int = PER_WORD_LIMIT,
          skip: int = PER_WORD_SKIP, scoring: str = "sum", require_all: bool = False) -> DataFrame:
    """SE3-SE5: (query_id, url, score) for every candidate URL.

    ``scoring='sum'``: sum over the distinct query words of count(word, url),
    a missing count being 0.  ``scoring='literal'``: the reference's loop --
    the count of the first query word whose top-k holds the URL, times the
    number of query words whose top-k holds it, plus the counts of the words
    whose top-k misses it.  ``require_all``: drop candidates missing a word.
    ``postings`` is a table or the snapshot of a ``PostingStore``."""
    if scoring not in ("sum", "literal"):
        raise ValueError(f"unknown scoring {scoring!r}")
    # The analysed queries (queries x words rows) and the top-k postings
    # (tokens x k rows) are small, bounded and used several times: both are
    # written once, so neither the query tokeniser nor the postings top-k job
    # runs again for the size checks or for each branch of the plan below.
    checkpoint_dir(queries_analyzed.sparkSession)
    q = queries_analyzed.select("query_id", "token", "qpos").checkpoint()
    if isinstance(postings, Snapshot):
        # a stored index: only the tokens' buckets are read, and the heads kept
        # there are the top-k
        relevant = postings.postings(q)
        if skip + k <= postings.head:
            top = postings.heads(q, k, skip)
        else:
            top = _top_k(relevant, k, skip)
    else:
        # the query tokens are few (queries x words); broadcast after a size check
        # so the postings are filtered in place, not shuffled by a hot token
        wanted = broadcast_if_small(q.select("token").distinct())
        relevant = postings.join(wanted, "token", "left_semi").select("token", "url", "count")
        top = _top_k(relevant, k, skip)
    top = top.select("token", "url").checkpoint()
    cand = q.join(top, "token").select("query_id", "url").distinct()
    # SE4 needs the postings of candidate URLs only, and only those that exist:
    # a missing count adds nothing to a score
    cand_urls = broadcast_if_small(cand.select("url").distinct())
    needed = relevant.join(cand_urls, "url", "left_semi")
    grid = (needed.join(top.withColumn("in_top", F.lit(True)), ["token", "url"], "left")
            .join(q, "token").join(cand, ["query_id", "url"], "left_semi")
            .select("query_id", "url", "qpos", F.coalesce("in_top", F.lit(False)).alias("in_top"), F.col("count").alias("c")))
    if scoring == "sum":
        s = F.sum("c")
    else:
        first = F.min(F.when(F.col("in_top"), F.struct("qpos", "c")))
        n_top = F.count(F.when(F.col("in_top"), F.lit(1)))
        s = first["c"] * n_top + F.coalesce(F.sum(F.when(~F.col("in_top"), F.col("c"))), F.lit(0))
    out = grid.groupBy("query_id", "url").agg(s.cast("bigint").alias("score"), F.count(F.lit(1)).alias("_n"))
    if require_all:
        words = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("_words"))
        out = out.join(words, "query_id").filter(F.col("_n") == F.col("_words")).drop("_words")
    return out.drop("_n")


def rank(scored: DataFrame) -> DataFrame:
    """SE6: rank per query, score desc, url asc (the url tie-break is ours)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("url"))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint"))


def search(queries: DataFrame, postings: DataFrame | Snapshot, stem: bool = True, k: int = PER_WORD_LIMIT,
           skip: int = PER_WORD_SKIP, scoring: str = "sum", require_all: bool = False,
           id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """SE1-SE6, SE10: (query_id, rank, url, score)."""
    q = analyze(queries, stem=stem, id_col=id_col, text_col=text_col)
    return rank(score(q, postings, k, skip, scoring, require_all)).select(
        "query_id", "rank", "url", "score")


def page_after(ranked: DataFrame, cursors: DataFrame, size: int) -> DataFrame:
    """SE9: the next ``size`` rows of each query's stored results ``(query_id,
    url, score, ...)`` behind a keyset cursor ``(query_id, score, url)``, the
    last row that was shown; a null score asks for the first page.  Queries
    without a cursor row are not asked for.  Unlike an offset, a cursor skips
    and repeats nothing when rows before it appear or go, and the rows before
    it are neither sorted nor moved; at most ``size`` rows of a query leave a
    map task (group limit)."""
    after = cursors.select("query_id", F.col("score").alias("_s"), F.col("url").alias("_u"))
    behind = (F.col("_s").isNull() | (F.col("score") < F.col("_s"))
              | ((F.col("score") == F.col("_s")) & (F.col("url") > F.col("_u"))))
    rows = ranked.join(broadcast_if_small(after), "query_id").filter(behind).select(*ranked.columns)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("url"))
    return (rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_n"))


def next_cursors(page: DataFrame) -> DataFrame:
    """The cursor behind each query's page: its last row."""
    last = F.max_by(F.struct("score", "url"), F.struct(-F.col("score"), "url"))
    return page.groupBy("query_id").agg(last.alias("_c")).select("query_id", "_c.score", "_c.url")


def results(ranked: DataFrame, pages: DataFrame) -> DataFrame:
    """SE7-SE8: join the ranked URLs to non-stub pages and add the result-page
    columns.  Candidates without a full page row are dropped (the reference
    fails the request), and ranks are renumbered over what remains.  Of
    several rows of a URL the first by ``ingest_seq`` is shown (without that
    column, the smallest title and description), so a result is listed once."""
    first = "ingest_seq" if "ingest_seq" in pages.columns else F.struct("title", "description")
    full = (pages.filter(F.col("title").isNotNull()).groupBy("url")
            .agg(F.min_by(F.struct("title", "description"), first).alias("_p"))
            .select("url", "_p.title", "_p.description"))
    joined = ranked.select("query_id", "url", "score").join(full, "url")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("url"))
    return joined.select(
        "query_id",
        F.row_number().over(w).cast("bigint").alias("rank"),
        "url",
        text.default_if_empty("title", text.NO_TITLE).alias("title"),
        text.default_if_empty(text.snippet("description"), text.NO_DESCRIPTION).alias("description"),
        "score",
        F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("n_results"),
    )


def image_results(ranked: DataFrame, images: DataFrame) -> DataFrame:
    """SE11: ranked image URLs with their alt text and page."""
    return (ranked.select("query_id", "rank", "url", "score")
            .join(images.select("url", "alt", "page_url"), "url")
            .select("query_id", "rank", "url", "alt", "page_url", "score"))
