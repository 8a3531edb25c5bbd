"""Page parsing: raw responses -> page rows, link edges, images, rejects
(SRC1, HX1-HX8, HX11, LG3, SNK2).

``parse`` is one projection over the scan: no shuffle, no Python.  The HTML
column is large, so callers should ``persist`` the parsed frame only when
several sinks read it (``ingest`` does, inside ``foreachBatch``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls


def parse(raw: DataFrame, break_on: str = "close_tag") -> DataFrame:
    """HX1-HX8 over ``raw`` (url, fetch_url, html, fetched_at, ingest_seq).

    Output: url, title, description, urls (array), text, images
    (array<struct<src, alt>>), time, ingest_seq.  Rejected rows (HX11) are
    excluded; see ``rejects``.  ``break_on`` is the Q12 option of
    ``html.page_text``."""
    ok = raw.filter(~html.is_blank("html"))
    # Each stage is its own projection and reads the previous stage's
    # columns by reference, so no large expression is repeated in the tree.
    s1 = ok.select("url", "fetch_url", "fetched_at", "ingest_seq",
                   html.cleaned("html").alias("_clean"))
    s2 = s1.select("url", "fetch_url", "fetched_at", "ingest_seq", "_clean",
                   html.base_href("_clean").alias("_bhref"),
                   html.meta_description_tag("_clean").alias("_meta"))
    s3 = s2.select("url", "fetch_url", "fetched_at", "ingest_seq", "_clean", "_meta",
                   html.base_url("_bhref", "fetch_url").alias("_base_url"))
    s4 = s3.select("url", "fetched_at", "ingest_seq", "_clean", "_meta",
                   urls.base_parts("_base_url").alias("_base"))
    return s4.select(
        "url",
        html.title("_clean").alias("title"),
        html.description("_meta").alias("description"),
        html.links("_clean", "_base").alias("urls"),
        html.page_text("_clean", break_on).alias("text"),
        html.images("_clean").alias("images"),
        F.col("fetched_at").alias("time"),
        "ingest_seq",
    )


def rejects(raw: DataFrame) -> DataFrame:
    """HX11: responses the parser cannot use (empty or blank document)."""
    return (raw.filter(html.is_blank("html"))
            .select("url", "ingest_seq", F.lit("empty document").alias("reason")))


def link_edges(parsed: DataFrame) -> DataFrame:
    """LG3 as an edge list: (src, dst, pos) in document order, plus the
    fragment-free target key ``dst_key`` (UR2) used by the link graph."""
    return (parsed.select(F.col("url").alias("src"), F.posexplode_outer("urls").alias("pos", "dst"))
            .filter(F.col("dst").isNotNull())
            .withColumn("dst_key", urls.remove_fragments("dst"))
            .select("src", "dst", "dst_key", F.col("pos").cast("int").alias("pos")))


def image_rows(parsed: DataFrame) -> DataFrame:
    """HX8 exploded: (url=src, alt, page_url, time, ingest_seq, img_pos)."""
    return (parsed.select(F.col("url").alias("page_url"), "time", "ingest_seq",
                          F.posexplode_outer("images").alias("img_pos", "img"))
            .filter(F.col("img").isNotNull())
            .select(F.col("img.src").alias("url"), F.col("img.alt").alias("alt"),
                    "page_url", "time", "ingest_seq", "img_pos"))
