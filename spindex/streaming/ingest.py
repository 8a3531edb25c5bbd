"""Structured Streaming ingest (ST1-ST5, SNK2, SNK3).

A crawl is an unbounded stream of raw pages.  Each micro-batch goes through
the same batch operators and is fanned out, in the reference's flush order,
to the tables of one output folder:

    postings/                  a PostingStore, one run per batch     (ST3)
    image_postings/batch_id=N  (token, url, count) delta of images   (M4)
    images/batch_id=N          (url, alt, page_url) rows             (M2)
    pages/batch_id=N           parsed page rows                      (ST2)
    links/batch_id=N           (url, backlink) pairs                 (ST5)

Each write overwrites its own ``batch_id`` partition, and the store refuses a
batch it holds, so a micro-batch that is replayed after a failure leaves the
tables unchanged (idempotent sink).
Readers merge on read: runs not yet compacted are summed, pages are first-full-wins,
backlinks are a set.  State lives in files, not in operator state; the only
stateful stream operator is ``running_counts`` (ST4).
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import images, links, merge, pages, postings
from ..operators.store import PostingStore
from ..session import checkpoint_dir, is_folder
from ..sources import tables

DRIVER_PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


#: Part files of a page table that one micro-batch takes.
PART_FILES = 64
#: Buckets of a stream's posting store.
BUCKETS = 16


def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run, inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def raw_page_stream(spark: SparkSession, folder: str, file_glob: str = "*.parquet",
                    max_files_per_trigger: int = 1) -> DataFrame:
    """ST1: driver-format page files arriving in ``folder`` (those matching
    ``file_glob``) as a stream, shaped like ``raw_pages``."""
    s = (spark.readStream.schema(DRIVER_PAGES_SCHEMA).option("pathGlobFilter", file_glob)
         .option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder))
    return tables.responses(s.select(
        "url", "html", F.lit(200).alias("status"), F.lit(None).cast("string").alias("referrer"),
        F.lit(None).cast("timestamp").alias("fetched_at"), F.col("page_id").alias("ingest_seq")))


def page_table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 over the driver ``pages`` table, a file or a folder of part files."""
    folder = f"{sf_dir.rstrip('/')}/pages.parquet"
    if is_folder(spark, folder):
        return raw_page_stream(spark, folder, "*.parquet", max_files_per_trigger=PART_FILES)
    return raw_page_stream(spark, sf_dir, "pages.parquet")


def response_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1) -> DataFrame:
    """ST1: crawl responses with their own status, referrer and fetch time
    (the columns of ``RAW_PAGES_SCHEMA``) arriving as Parquet files."""
    return tables.responses(spark.readStream.schema(tables.RAW_PAGES_SCHEMA)
                            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder))


def _write_partition(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def posting_store(spark: SparkSession, out: str) -> PostingStore:
    """The posting store of a stream's output folder, made where there is none."""
    store = PostingStore(spark, f"{out}/postings")
    return store if store.versions() else PostingStore.create(spark, store.path, buckets=BUCKETS)


def fan_out(out: str, stem: bool = True, compact_after: int = 8):
    """SNK2/SNK3: the ``foreachBatch`` function -- parse once, then write the
    token postings, image postings, images, pages and links (backlinks), in
    that order.  Postings go to a ``PostingStore``, whose runs are merged once
    there are ``compact_after``.  ``run.seen`` holds the pages of each batch it has written."""
    def run(batch: DataFrame, batch_id: int) -> None:
        ok = tables.only_ok(tables.spread(batch))  # a file of one row group is one task of the batch
        parsed = pages.parse(ok).drop("images").persist()
        contexts = images.image_contexts(ok).persist()
        try:
            store = posting_store(batch.sparkSession, out)
            counts = postings.term_counts(parsed.select("url", "text"), stem=stem, parts=postings.count_parts(parsed))
            store.append(str(batch_id), counts, summed=True)
            if len(store.manifest()["runs"]) >= compact_after:
                store.compact()
                store.vacuum()
            _write_partition(images.image_postings(contexts, stem=stem), f"{out}/image_postings", batch_id)
            rows = contexts.select(F.col("src").alias("url"), "alt", "page_url", "ingest_seq", "img_pos")
            _write_partition(rows, f"{out}/images", batch_id)
            _write_partition(parsed.drop("text"), f"{out}/pages", batch_id)
            _write_partition(links.backlinks(pages.link_edges(parsed)), f"{out}/links", batch_id)
            run.seen[batch_id] = parsed.count()
        finally:
            parsed.unpersist()
            contexts.unpersist()
    run.seen = {}
    return run


def ingest(raw_stream: DataFrame, out: str, stem: bool = True) -> dict:
    """Run the fan-out over everything available now and wait for it.

    Returns the run summary of AG1 that is not a table size: elapsed seconds,
    micro-batches and pages scraped, counted as they are written (a replayed
    batch counts once; the query's progress reports keep only the last ones)."""
    t0 = time.time()
    run = fan_out(out, stem)
    q = (raw_stream.writeStream.foreachBatch(run)
         .option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return {"elapsed_sec": round(time.time() - t0, 3), "batches": len(run.seen),
            "pages_read": sum(run.seen.values())}


def read_postings(spark: SparkSession, out: str) -> DataFrame:
    """ST3 read side: deltas summed per (token, url)."""
    return posting_store(spark, out).snapshot().postings().select(*postings.POSTINGS_COLUMNS)


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table of ``batch_id`` partitions; empty before the first batch."""
    if not is_folder(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def read_pages(spark: SparkSession, out: str) -> DataFrame:
    """ST2 read side: first full row per URL key across all batches; an
    earlier batch comes first, whatever its ``ingest_seq``."""
    rows = _read(spark, f"{out}/pages", "url string, title string, description string, urls array<string>, time timestamp, "
                 "ingest_seq bigint, batch_id int")
    return merge.first_full_rows(rows, ("batch_id", "ingest_seq"))


def read_images(spark: SparkSession, out: str) -> DataFrame:
    """M2 read side: one row per image URL, the first one ingested."""
    rows = _read(spark, f"{out}/images", "url string, alt string, page_url string, ingest_seq bigint, img_pos int, batch_id int")
    best = F.min_by(F.struct("url", "alt", "page_url"), F.struct("batch_id", "ingest_seq", "img_pos"))
    return rows.groupBy("url").agg(best.alias("_r")).select("_r.*")


def read_image_postings(spark: SparkSession, out: str) -> DataFrame:
    """M4 read side: image deltas summed per (token, url)."""
    d = _read(spark, f"{out}/image_postings", "token string, url string, count bigint, batch_id int")
    return (d.groupBy("token", "url").agg(F.sum("count").alias("count"))
            .select(*postings.POSTINGS_COLUMNS))


def read_backlinks(spark: SparkSession, out: str) -> DataFrame:
    """ST5 read side: the set of (url, backlink) pairs."""
    return _read(spark, f"{out}/links", "url string, backlink string, batch_id int").select("url", "backlink").distinct()


def running_counts(raw_stream: DataFrame, out: str) -> None:
    """ST4: running (token, url) counts as a stateful streaming aggregation in
    update mode; each micro-batch's updated counts go to their own
    ``batch_id`` partition.  The state grows with the distinct pairs (no
    event time to expire it), so this is for bounded inputs."""
    parsed = pages.parse(tables.only_ok(raw_stream))
    occ = postings.occurrences(parsed.select("url", "text"), stem=False)
    counts = occ.groupBy("token", "url").agg(F.count(F.lit(1)).alias("count"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_partition(batch, f"{out}/counts", batch_id)

    q = (counts.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{out}/_checkpoint_counts")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_running_counts(spark: SparkSession, out: str) -> DataFrame:
    """Latest running count of every (token, url)."""
    d = _read(spark, f"{out}/counts", "token string, url string, count bigint, batch_id int")
    return (d.groupBy("token", "url").agg(F.max_by("count", "batch_id").alias("count"))
            .select(*postings.POSTINGS_COLUMNS))
