"""Images: rows, context text, image postings and image search
(HX8-HX10, M2, M4, SE11, SNK4).

The context of an image is the text of its nearest ancestor (starting at the
parent) whose text is longer than 300 characters, or the whole document.  It is
a containment join in array form: ``functions.tree`` folds a page's tags into
the spans of the elements that hold images, and an image takes the innermost
span around it that is long enough.  Everything is one projection over the
pages that contain ``<img``, without a shuffle and without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, tree
from . import merge, postings

CONTEXT_MIN_CHARS = 300   # fixed value: an ancestor's text must be longer than this


def image_contexts(raw: DataFrame) -> DataFrame:
    """HX8+HX9: one row per image of the raw pages (url, ingest_seq, html),
    with its context text: (page_url, ingest_seq, img_pos, src, alt, context)."""
    pages = raw.filter(F.lower(F.col("html")).contains("<img")).select("url", "ingest_seq", html.cleaned("html").alias("_clean"))
    # each stage is its own projection and reads the columns of the one before
    s1 = pages.select("url", "ingest_seq", tree.tags("_clean").alias("_tags"), tree.pieces("_clean").alias("_texts"),
                      html.images("_clean").alias("_images"))
    s2 = s1.select("url", "ingest_seq", "_images", F.array_join("_texts", "").alias("_doc"), tree.events("_tags", "_texts").alias("_events"))
    s3 = s2.select("url", "ingest_seq", "_images", "_doc", F.length("_doc").alias("_length"), "_events",
                   tree.image_spans("_events", F.length("_doc")).alias("_spans"))
    at = F.transform(F.filter("_events", lambda e: e["img"]), lambda e: e["i"])
    s4 = s3.select("url", "ingest_seq", "_doc", F.arrays_zip(
        F.col("_images"), F.transform(at, lambda i: tree.nearest(F.col("_spans"), i, CONTEXT_MIN_CHARS, F.col("_length"))).alias("span")
    ).alias("_found"))
    rows = s4.select(F.col("url").alias("page_url"), "ingest_seq", "_doc", F.posexplode_outer("_found").alias("img_pos", "_f"))
    rows = rows.filter(F.col("_f").isNotNull())
    return rows.select("page_url", "ingest_seq", F.col("img_pos").cast("int").alias("img_pos"), F.col("_f._images.src").alias("src"),
                       F.col("_f._images.alt").alias("alt"),
                       F.col("_doc").substr(F.col("_f.span.start") + 1, F.col("_f.span.end") - F.col("_f.span.start")).alias("context"))


def _text() -> Column:
    """What is indexed of an image: its context and its alternative text."""
    return F.concat_ws(" ", "context", "alt")


def image_table(contexts: DataFrame, keep_tokens: bool = False, stem: bool = True) -> DataFrame:
    """M2: the images collection -- one row per image URL, the first page's
    row wins (every src-less image shares the key '').  ``keep_tokens`` (SNK4,
    upload switch off) leaves the winning row's tokens on it; only winners are
    tokenised."""
    fields = ("url", "alt", "page_url") + (("text",) if keep_tokens else ())
    rows = contexts.select(F.col("src").alias("url"), "alt", "page_url", "ingest_seq", "img_pos", _text().alias("text"))
    best = F.min_by(F.struct(*fields), F.struct("ingest_seq", "img_pos"))
    table = rows.groupBy("url").agg(best.alias("_r")).select("_r.*")
    return postings.tokens_column(table, stem=stem, keep=("alt", "page_url")) if keep_tokens else table


def image_postings(contexts: DataFrame, stem: bool = True) -> DataFrame:
    """HX10 + M4: tokens of context + ' ' + alt, counted per image URL over
    every occurrence of the image (duplicates on other pages add up)."""
    corpus = contexts.select(F.col("src").alias("url"), _text().alias("text"))
    return postings.term_counts(corpus, stem=stem)


def merge_image_postings(existing: DataFrame, delta: DataFrame) -> DataFrame:
    """M4: image postings upsert (same algebra as page postings)."""
    return merge.upsert_postings(existing, delta)
