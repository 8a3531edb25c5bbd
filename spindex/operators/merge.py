"""Incremental maintenance: merging a new batch into stored tables
(SNK1, M1-M7).

Every merge is a union followed by a keyed aggregation, never a row-by-row
upsert.  "First wins" choices use ``min_by`` over an ordering struct, which
Spark aggregates partially on the map side, so even a key repeated across a
large share of the input is reduced before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import postings as P
from .links import page_key
from .sizing import broadcast_if_small

PAGE_COLUMNS = ("url", "title", "description", "urls", "time", "ingest_seq")


def insert_ignore(existing: DataFrame, batch: DataFrame, key: str, order: str = "ingest_seq") -> DataFrame:
    """SNK1 / M2: unordered bulk insert where a duplicate key is ignored --
    stored rows win, then the batch row with the lowest ``order``."""
    cols = existing.columns
    tagged = (existing.withColumn("_new", F.lit(0))
              .unionByName(batch.select(*cols).withColumn("_new", F.lit(1))))
    best = F.min_by(F.struct(*cols), F.struct("_new", order))
    return tagged.groupBy(key).agg(best.alias("_r")).select("_r.*")


def merge_pages(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """M1 (content half): per URL key the first *full* row wins -- a full row
    replaces a stub, a later full row is ignored.  A stored row comes before
    any row of the batch, whatever its ``ingest_seq``; within one side the
    lowest ``ingest_seq`` wins.  Rows are keyed by the fragment-free URL (UR2)."""
    tagged = (existing.select(*PAGE_COLUMNS, F.lit(0).alias("_new"))
              .unionByName(batch.select(*PAGE_COLUMNS, F.lit(1).alias("_new"))))
    return first_full_rows(tagged, ("_new", "ingest_seq"))


def first_full_rows(rows: DataFrame, order: tuple[str, ...] = ("ingest_seq",)) -> DataFrame:
    """The M1 choice over any number of ingests: per URL key the full row
    that comes first by ``order``, else the stub."""
    u = rows.select(*dict.fromkeys((*PAGE_COLUMNS, *order)), page_key("url").alias("_key"))
    best = F.min_by(F.struct(*PAGE_COLUMNS), F.struct(F.col("title").isNull().alias("_stub"), *order))
    return u.groupBy("_key").agg(best.alias("_r")).select("_r.*")


def merge_backlinks(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """M1 (link half) / M7: set union of (url, backlink) pairs -- referrers of
    an ignored duplicate are kept (quirk Q8 is not reproduced)."""
    return existing.select("url", "backlink").unionByName(batch.select("url", "backlink")).distinct()


def page_view(pages: DataFrame, backlinks: DataFrame) -> DataFrame:
    """The stored page collection: one row per known URL key -- full pages
    and stubs (linked, never fetched: title NULL) -- with the number of
    backlinks.  Counting is a combinable aggregate on the flat pairs."""
    full = pages.select(page_key("url").alias("url"), "title", "description")
    deg = backlinks.groupBy("url").agg(F.count(F.lit(1)).alias("n_backlinks"))
    return (full.join(deg, "url", "full")
            .select("url", "title", "description",
                    F.col("title").isNull().alias("is_stub"),
                    F.coalesce("n_backlinks", F.lit(0)).cast("bigint").alias("n_backlinks")))


def upsert_postings(existing: DataFrame, delta: DataFrame, parts: int | None = None) -> DataFrame:
    """M3 / M4: counts of the same (token, url) add up; new pairs are added.
    ``parts``: see ``postings.merge_postings``."""
    return P.merge_postings(existing, delta, parts)


def recrawl(existing_postings: DataFrame, stored_pages: DataFrame, batch_pages: DataFrame,
            batch_postings: DataFrame, on_recrawl: str = "add", parts: int | None = None) -> DataFrame:
    """M5: a re-crawled URL adds its counts again (``'add'``, as the
    reference does although the page row itself is ignored) or is skipped
    (``'skip'``: the batch postings of already stored URLs are dropped)."""
    if on_recrawl == "add":
        return upsert_postings(existing_postings, batch_postings, parts)
    if on_recrawl != "skip":
        raise ValueError(f"unknown on_recrawl {on_recrawl!r}")
    checkpoint_dir(batch_pages.sparkSession)
    stored = stored_pages.select("url").distinct()
    # read for its size and for the join, which moves no postings where it fits
    new_urls = batch_pages.select("url").distinct().join(stored, "url", "left_anti").checkpoint()
    fresh = batch_postings.join(broadcast_if_small(new_urls), "url", "left_semi")
    return upsert_postings(existing_postings, fresh, parts)


def lookup(postings: DataFrame, tokens: DataFrame, urls: DataFrame) -> DataFrame:
    """M6: postings of the given tokens restricted to the given URLs (two semi
    joins; both key lists are broadcast by AQE when small)."""
    return (postings.join(tokens.select("token").distinct(), "token", "left_semi")
            .join(urls.select("url").distinct(), "url", "left_semi"))
