"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest.  New
data is reduced to one row per digest before it moves, deduplicated against
the index by a sort-merge anti-join (the index side is read in bucket order
and not shuffled), and appended.  Digests that the index already has are
appended too, as *sightings*, so that counts and the choice of the row that
stays stay right over any number of batches.

Texts are equal when they are identical after deleting every ASCII white
space character.  Of equal texts the row with the most code points, then the
smallest key (null last), then the row seen first stays.  Null text counts as
empty, and empty texts are equal to each other.  Of repeated rows (same key,
same text) exactly one stays.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import list_names, read_text, write_new_text
from .common import SPACE, numbered, original, partitions, shared_path, stored


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``batch, row, k, n_chars, digest`` per row: all that is needed of the
    texts, written once (so a row keeps its number)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return stored(docs.select(
        F.lit(uuid.uuid4().hex).alias("batch"), F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"),
        F.length(t).cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.translate(t, SPACE, "").cast("binary"), 256)).alias("digest")), "fingerprints")


_BEST = ("n_chars", "no_key", "k", "batch", "row")


def _best():
    return F.min(F.struct((-F.col("n_chars")).alias("n_chars"), F.col("k").isNull().alias("no_key"), "k", "batch", "row"))


class DigestIndex:
    """The index at ``path``; an empty one is made where there is none.

    The bucket count and the key's type are part of the stored data: they lie
    beside it, and the index is opened with them whatever the session's settings
    are.  Asking for others than those stored is an error.  ``close`` drops the
    catalog entry; the data stay."""

    def __init__(self, spark: SparkSession, path: str, key_type: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        asked = {k: v for k, v in (("key_type", key_type), ("buckets", buckets)) if v is not None}
        if "_settings.json" in list_names(spark, self.path):
            stored_ = json.loads(read_text(spark, f"{self.path}/_settings.json"))
            if any(stored_[k] != v for k, v in asked.items()):
                raise ValueError(f"the index at {path} has {stored_}, not {asked}")
        else:
            stored_ = {"key_type": "bigint", "buckets": partitions(spark)} | asked
            write_new_text(spark, f"{self.path}/_settings.json", json.dumps(stored_))
        self.key_type, self.buckets = stored_["key_type"], stored_["buckets"]
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, best STRUCT<n_chars: BIGINT, no_key: BOOLEAN, k: {self.key_type}, "
            f"batch: STRING, row: BIGINT>, n BIGINT, is_new BOOLEAN) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _append(self, rows: DataFrame) -> None:
        (rows.select("digest", "best", "n", "is_new").repartition(self.buckets, "digest").write.format("parquet")
         .mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path)
         .saveAsTable(self.name))

    def add(self, prints: DataFrame) -> DataFrame:
        """Deduplicates a batch of :func:`fingerprints` against the index and
        appends it.  Returns the batch's digests with ``is_new`` (the index
        did not have it)."""
        batch = prints.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))
        # a digest is new in one row at most: the row of the batch that brought it
        known = self.spark.table(self.name).where("is_new").select("digest")
        new = batch.join(known.hint("merge"), "digest", "left_anti").withColumn("is_new", F.lit(True))
        new = stored(new, "new")
        seen = batch.join(known.hint("merge"), "digest", "left_semi").withColumn("is_new", F.lit(False))
        seen = stored(seen, "seen")
        self._append(new.unionByName(seen))
        return new.unionByName(seen)

    def groups(self) -> DataFrame:
        """``digest, best, n`` per digest over all batches."""
        return (self.spark.read.schema(self.spark.table(self.name).schema).parquet(self.path)
                .groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n")))

    def decide(self, prints: DataFrame, key: str = "doc_id") -> DataFrame:
        """Per row of ``prints``: ``key, keep_id, group_size, kept, text_sha256, n_chars``.
        The groups are written first: the join is then of two plain scans, and
        Spark may split a hot digest's rows."""
        g = stored(self.groups().select("digest", "best", "n"), "groups")
        kept = (F.col("best.batch") == F.col("p.batch")) & (F.col("best.row") == F.col("p.row"))
        return prints.alias("p").join(g, "digest").select(
            F.col("p.k").alias(key), F.col("best.k").alias("keep_id"), F.col("n").alias("group_size"),
            kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("p.n_chars").alias("n_chars"))


BATCHES = 2


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", index: DigestIndex | None = None,
          batches: int = BATCHES) -> DataFrame:
    """Adds ``docs`` to ``index`` (a new one by default) and decides on its rows.
    All rows go in, in ``batches`` dealt by a hash of the key: each but the
    first is deduplicated against what the index holds by then."""
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark, shared_path(spark, "digest_index"), docs.schema[key].dataType.simpleString())
    prints = fingerprints(docs, key, text)
    for b in range(batches):
        index.add(prints.where(F.pmod(F.xxhash64("k"), F.lit(batches)) == b))
    decisions = index.decide(prints, key)
    if own:
        index.close()
    return decisions


def survivors(docs: DataFrame, decisions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Rows are found
    again by key, length and digest; rows that agree in all three are
    interchangeable, and one of them stays."""
    t = F.coalesce(F.col(text), F.lit(""))
    same = decisions.groupBy(F.col(key).alias("of"), "n_chars", "text_sha256").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n_same"))
    rows = numbered(docs, F.col(key).alias("k"), F.length(t).cast("long").alias("n_chars"),
                    F.sha2(F.translate(t, SPACE, "").cast("binary"), 256).alias("text_sha256"))
    found = rows.join(same.where("kept").withColumnsRenamed({"n_chars": "of_chars", "text_sha256": "of_sha256"}), (
        F.col("k").eqNullSafe(F.col("of")) & (F.col("n_chars") == F.col("of_chars")) & (F.col("text_sha256") == F.col("of_sha256"))))
    again = found.where("n_same > 1").dropDuplicates(["k", "n_chars", "text_sha256"])
    return original(found.where("n_same = 1"), docs).unionByName(original(again, docs))
