"""Readers for the input tables (SRC1-SRC5).

Every reader returns a DataFrame over Parquet or text files; projection and
filters applied later are pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..session import file_stamps

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

#: Bytes of a file that one task should read, and the parts that rows are dealt
#: to at most (with more, the shuffle's writer gathers a task's rows in memory).
SPLIT_BYTES = 16 << 20
MOST_PARTS = 200

RAW_PAGES_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("referrer", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("ingest_seq", T.LongType()),
])

# The built-in crawl definitions (name, start URLs, allowed
# domains; None = every domain allowed).
CRAWL_DEFS = (
    ("ent", ("https://www.reddit.com", "https://www.twitter.com", "https://www.gamepedia.com",
             "https://www.fandom.com"),
     ("reddit.com", "twitter.com", "gamepedia.com", "fandom.com")),
    ("misc", ("https://www.google.com", "https://en.m.wikipedia.org/wiki/Main_Page",
              "https://www.espn.com"),
     ("google.com", "en.m.wikipedia.org", "espn.com")),
    ("misc2", ("https://www.stackoverflow.com", "https://www.w3schools.com",
               "https://www.freecodecamp.org"), None),
    ("news", ("https://www.nytimes.com", "https://www.bbc.com", "https://www.cnn.com"),
     ("www.nytimes.com", "www.bbc.com", "www.cnn.com")),
    ("news2", ("https://www.cbsnews.com", "https://weather.com", "https://www.yahoo.com"),
     ("cbsnews.com", "weather.com", "yahoo.com")),
    ("quotes", ("https://quotes.toscrape.com", "https://www.brainyquote.com",
                "https://www.barnesandnoble.com"), None),
    ("test", ("https://www.nytimes.com",), ("www.nytimes.com",)),
    ("from_file", (), None),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, size: int | None = None) -> DataFrame:
    """Deals the rows out where the scan would give a task much more than
    ``SPLIT_BYTES``, or leave task slots without work: Parquet is split at row
    groups only, so a file of one row group is read by one task, however many
    splits its length asks for.  ``size``: bytes of the files; without it the
    strings are measured (a stream's batch).  Rows are dealt by a number, not
    round-robin, which would first sort all of a task's rows in its memory."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    at, n = df.groupBy(F.spark_partition_id().alias("p")), F.count(F.lit(1)).alias("n")
    if size is None:
        strings = [F.octet_length(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"]
        found = at.agg(n, F.sum(sum((F.coalesce(b, F.lit(0)) for b in strings), F.lit(0).cast("bigint"))).alias("b")).collect()
        size = sum(r["b"] for r in found)
    else:
        found = at.agg(n).collect()  # read from the footers
    rows = [r["n"] for r in found]
    parts = max(slots, min(-(-size // SPLIT_BYTES), MOST_PARTS))
    if len(rows) >= slots and max(rows) * parts <= 2 * sum(rows):
        return df
    return df.withColumn("_deal", F.monotonically_increasing_id()).repartition(parts, "_deal").drop("_deal")


def _spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    files = file_stamps(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(table(spark, sf_dir, name), sum(length for _, length, _ in files))


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a corpus ``(url, text)``; the doc id is the URL key."""
    return _spread_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "text")


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 over the driver ``pages`` table: the stored page key is the
    formatted URL, the base for link resolution is the URL as fetched, the
    HTML is ``''`` when absent.  Driver pages carry no status, referrer or
    fetch time (all 200 / NULL); ``page_id`` orders ingestion."""
    p = _spread_table(spark, sf_dir, "pages")
    return p.select(
        urls.format_url("url").alias("url"),
        F.col("url").alias("fetch_url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("referrer"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
        F.col("page_id").cast("bigint").alias("ingest_seq"),
    )


def responses(df: DataFrame) -> DataFrame:
    """SRC1 over a generic response table ``(url, html, status, referrer,
    fetched_at, ingest_seq)``: same shape as ``raw_pages``."""
    return df.select(
        urls.format_url("url").alias("url"),
        F.col("url").alias("fetch_url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.col("status").cast("int").alias("status"),
        F.col("referrer"),
        F.col("fetched_at").cast("timestamp").alias("fetched_at"),
        F.col("ingest_seq").cast("bigint").alias("ingest_seq"),
    )


def only_ok(raw: DataFrame) -> DataFrame:
    """SRC2: only status 200 is parsed and followed."""
    return raw.filter(F.col("status") == 200)


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: one start URL per line."""
    return spark.read.text(path).select(F.col("value").alias("url"))


def allowed_domains(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: one allowed domain per line."""
    return spark.read.text(path).select(F.col("value").alias("domain"))


def crawl_defs(spark: SparkSession) -> DataFrame:
    """SRC5: the built-in crawl definitions as a table."""
    schema = "name string, start_urls array<string>, allowed_domains array<string>"
    rows = [(n, list(s), None if d is None else list(d)) for n, s, d in CRAWL_DEFS]
    return spark.createDataFrame(rows, schema)


def crawl_seeds(defs: DataFrame) -> DataFrame:
    """SRC5 exploded: (name, url)."""
    return defs.select("name", F.explode("start_urls").alias("url"))
