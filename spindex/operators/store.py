"""Stored postings: a versioned, token-bucketed inverted index that is written
once and searched many times (SE2, SCN7, M3, ST3, AG2).

A ``VersionedFolder`` whose runs hold::

    postings/bucket=<b>/    (token, url, count), sorted by token, count desc, url
    heads/bucket=<b>/       (token, head): the best ``head`` postings of a token
    df/bucket=<b>/          (token, doc_freq)
    urls/                   the distinct URLs of the run

A run is the summed postings of a set of batches; ``append`` writes one per
batch, ``compact`` merges all into one.

Buckets are folders, and the bucket of a token is ``xxhash64(token) mod
buckets``: a search collects the buckets of its tokens (never more than there
are buckets) and reads only those.  Rows are rebalanced by bucket, and a large
bucket is dealt to several tasks by size, so a token that most pages hold is
many files, written by many tasks.  (Ranges of tokens would compute the rows
once more, to sample them.)

Heads and document frequencies are views kept up to date incrementally.
Counts only grow, so a posting that a batch does not touch and that was
outside its token's head still has as many postings above it: the old head and
the touched postings decide the new one exactly.  A token's document frequency
rises by its touched pairs that are new to the store.  Both need the old counts
of touched pairs only; a batch of pages that were never stored, which the URL
lists tell, reads no old postings at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .sizing import broadcast_if_small
from .versions import VersionedFolder, new_run

BUCKETS = 64
HEAD = 50          # fixed value: postings kept per query word

_POSTINGS = "token string, url string, count bigint, bucket int"
_HEADS = "token string, head array<struct<count: bigint, url: string>>, bucket int"
_DF = "token string, doc_freq bigint, bucket int"


class PostingStore(VersionedFolder):
    SETTINGS = ("buckets", "head")

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = BUCKETS, head: int = HEAD) -> PostingStore:
        return super().create(spark, path, buckets=buckets, head=head)

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self, self.manifest(version))

    # -------------------------------------------------------------- writing

    def _write(self, df: DataFrame, run: str, name: str, *order: str | Column, buckets: int) -> None:
        by = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
        (df.withColumn("bucket", by).hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
         .write.partitionBy("bucket").parquet(f"{self.path}/{run}/{name}"))

    def append(self, batch_id: str, delta: DataFrame, summed: bool = False) -> bool:
        """Adds a batch of postings ``(token, url, count)``, counts of a pair
        adding up.  ``summed``: the delta holds a pair once, as ``term_counts``
        gives them.  False, and nothing is done, if the batch is already in."""
        now = self.manifest()
        if self.holds(now, batch_id):
            return False
        checkpoint_dir(self.spark)
        before, run = Snapshot(self, now), new_run()
        rows = delta.select("token", "url", F.col("count").cast("bigint").alias("count"))
        if not summed:
            rows = rows.groupBy("token", "url").agg(F.sum("count").alias("count"))
        self._write(rows, run, "postings", "token", F.desc("count"), "url", buckets=now["buckets"])
        added = Snapshot(self, now | {"runs": [{"path": run, "batches": [batch_id]}]})
        rows = added.postings()
        rows.select("url").distinct().write.parquet(f"{self.path}/{run}/urls")
        touched = before._totals(rows, added.urls())
        fresh = touched.where("NOT known").groupBy("token").agg(F.count(F.lit(1)).alias("doc_freq"))
        self._write(fresh, run, "df", "token", buckets=now["buckets"])
        heads = touched.select("token", "url", "count")
        if now["runs"]:
            old = before.heads(rows.select("token").distinct(), now["head"]).select("token", "url", "count")
            # a touched posting of the old head is there with both counts: the larger is the new one
            heads = heads.unionByName(old).groupBy("token", "url").agg(F.max("count").alias("count"))
        self._write(_head(heads, now["head"]), run, "heads", "token", buckets=now["buckets"])
        self._add_run(now, run, batch_id)
        return True

    def compact(self) -> bool:
        """Merges all runs into one; False if there is nothing to merge."""
        now = self.manifest()
        if len(now["runs"]) < 2:
            return False
        all_, run = Snapshot(self, now), new_run()
        self._write(all_.postings(), run, "postings", "token", F.desc("count"), "url", buckets=now["buckets"])
        all_.urls().write.parquet(f"{self.path}/{run}/urls")
        self._write(all_.doc_frequency(), run, "df", "token", buckets=now["buckets"])
        self._write(all_._head_rows(), run, "heads", "token", buckets=now["buckets"])
        self._one_run(now, run)
        return True


def _head(postings: DataFrame, head: int) -> DataFrame:
    """(token, head) with the best ``head`` postings, count desc, url asc."""
    w = Window.partitionBy("token").orderBy(F.desc("count"), F.asc("url"))
    best = postings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= head)
    return best.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "count", "url"))),
                                                 lambda e: F.struct(e["count"], e["url"])).alias("head"))


class Snapshot:
    """The store as one manifest names it."""

    def __init__(self, store: PostingStore, manifest: dict):
        self.store, self.spark = store, store.spark
        self.buckets, self.head, self.runs = manifest["buckets"], manifest["head"], manifest["runs"]

    def _of(self, name: str, schema: str, tokens: DataFrame | None) -> DataFrame:
        """Rows of all runs with the run's number ``_run``, of the given tokens:
        the buckets of the tokens select the folders to read."""
        out = self.store.union([self.store.read_run(name, schema, r).withColumn("_run", F.lit(i))
                                for i, r in enumerate(self.runs)], schema + ", _run int")
        if tokens is None:
            return out
        wanted = tokens.select("token").distinct()
        found = wanted.select(F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()
        return out.where(F.col("bucket").isin([r["b"] for r in found])).join(broadcast_if_small(wanted), "token", "left_semi")

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """(token, url, count), of all or of the given tokens (``token``)."""
        rows = self._of("postings", _POSTINGS, tokens)
        if len(self.runs) < 2:
            return rows.select("token", "url", "count")
        return rows.groupBy("token", "url").agg(F.sum("count").alias("count"))

    def _head_rows(self, tokens: DataFrame | None = None) -> DataFrame:
        rows = self._of("heads", _HEADS, tokens)
        if len(self.runs) < 2:
            return rows.select("token", "head")
        return rows.groupBy("token").agg(F.max_by("head", "_run").alias("head"))

    def heads(self, tokens: DataFrame | None = None, k: int = HEAD, skip: int = 0) -> DataFrame:
        """SE2 / SE9: (token, url, count, word_rank), ranks skip+1 .. skip+k."""
        if skip + k > self.head:
            raise ValueError(f"the store keeps {self.head} postings per token")
        rows = self._head_rows(tokens).select("token", F.posexplode(F.slice("head", skip + 1, k)).alias("_i", "_p"))
        return rows.select("token", "_p.url", "_p.count", (F.col("_i") + skip + 1).alias("word_rank"))

    def doc_frequency(self, tokens: DataFrame | None = None) -> DataFrame:
        """AG2: (token, doc_freq)."""
        rows = self._of("df", _DF, tokens)
        if len(self.runs) < 2:
            return rows.select("token", "doc_freq")
        return rows.groupBy("token").agg(F.sum("doc_freq").alias("doc_freq"))

    def urls(self) -> DataFrame:
        out = self.store.union([self.store.read_run("urls", "url string", r) for r in self.runs], "url string")
        return out if len(self.runs) < 2 else out.distinct()

    def stats(self) -> DataFrame:
        """AG1 over the store: (metric, value) of tokens, postings, URLs and occurrences."""
        df = self.doc_frequency().agg(F.count(F.lit(1)).alias("tokens"), F.coalesce(F.sum("doc_freq"), F.lit(0)).alias("postings"))
        counts = self._of("postings", _POSTINGS, None).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("occurrences"))
        urls = self.urls().agg(F.count(F.lit(1)).alias("urls"))
        one = lambda d: [d.select(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in d.columns]
        return self.store.union([*one(df), *one(counts), *one(urls)], "metric string, value bigint")

    def _totals(self, rows: DataFrame, batch_urls: DataFrame) -> DataFrame:
        """Touched pairs with their new totals, and whether they were known."""
        new = rows.withColumn("known", F.lit(False))
        if not self.runs:
            return new
        again = batch_urls.join(self.urls(), "url", "left_semi")
        if again.isEmpty():
            return new
        old = (self.postings(rows.select("token").distinct()).join(broadcast_if_small(again), "url", "left_semi")
               .select("token", "url", F.col("count").alias("_old")))
        # read twice, so the look-up of old counts is written once
        return rows.join(old, ["token", "url"], "left").select(
            "token", "url", (F.col("count") + F.coalesce("_old", F.lit(0))).alias("count"),
            F.col("_old").isNotNull().alias("known")).checkpoint()
