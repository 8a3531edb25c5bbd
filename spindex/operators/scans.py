"""Collection reads and corpus statistics (SCN1-SCN7, AG1, AG3 helpers).

These are thin DataFrame compositions: the filters and projections reach the
Parquet scan (``PushedFilters`` / ``ReadSchema``), and no result is
gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c


def find(df: DataFrame, condition: Column | None = None, columns: Sequence[str] | None = None,
         order_by: Sequence[Column | str] | None = None, skip: int = 0,
         limit: int | None = None) -> DataFrame:
    """SCN1: find(filter, projection, sort, skip, limit) over a collection."""
    out = df if condition is None else df.filter(condition)
    if columns:
        out = out.select(*columns)
    if order_by:
        out = out.orderBy(*order_by)
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out


def count_where(df: DataFrame, condition: Column | None = None, name: str = "n") -> DataFrame:
    """SCN3: number of documents matching a filter, as a one-row frame."""
    out = df if condition is None else df.filter(condition)
    return out.agg(F.count(F.lit(1)).alias(name))


def exists_key(u: Column | str) -> Column:
    """SCN4's normaliser: trailing '/' stripped, then trailing spaces (not the
    same as ``format_url``)."""
    return F.rtrim(F.rtrim(_c(u), F.lit("/")), F.lit(" "))


def exists(candidates: DataFrame, url_col: str, pages: DataFrame) -> DataFrame:
    """SCN4: each candidate URL with a flag telling whether a stored page has
    the same normalised URL (left join with the distinct page keys)."""
    keys = pages.select(exists_key("url").alias("_k")).distinct().withColumn("exists", F.lit(True))
    return (candidates.withColumn("_k", exists_key(url_col)).join(keys, "_k", "left")
            .select(*candidates.columns, F.coalesce("exists", F.lit(False)).alias("exists")))


def time_range(df: DataFrame, ts_col: str, start: str, end: str) -> DataFrame:
    """SCN5: rows with ``start <= ts < end`` (pushed into the scan, row groups
    pruned by their min/max statistics).  Bounds are local date-times for a
    TIMESTAMP_NTZ column and session-zone instants for a TIMESTAMP column."""
    ts = F.col(ts_col)
    kind = df.schema[ts_col].dataType     # bounds typed like the column: no time-zone shift
    return df.filter((ts >= F.lit(start).cast(kind)) & (ts < F.lit(end).cast(kind)))


def pages_linked_from(backlinks: DataFrame, pages: DataFrame) -> DataFrame:
    """SCN6: (url, backlink) pairs whose target is a stored full page -- the
    'pages by backlink' index as a table."""
    full = pages.filter(F.col("title").isNotNull()).select(F.col("url").alias("_u")).distinct()
    return backlinks.join(full, backlinks["url"] == full["_u"], "left_semi")


def forward_summary(postings: DataFrame) -> DataFrame:
    """SCN7: per URL its number of distinct tokens and of token occurrences."""
    return postings.groupBy("url").agg(F.count(F.lit(1)).alias("n_tokens"),
                                       F.sum("count").cast("bigint").alias("n_occurrences"))


def corpus_stats(metrics: dict[str, DataFrame]) -> DataFrame:
    """AG1: one (metric, value) row per named table size; a union of
    counts, no cross join."""
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("value")).select(F.lit(name).alias("metric"), "value")
             for name, df in metrics.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
