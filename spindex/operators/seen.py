"""The seen set: which URLs were fetched, over any number of crawls (LG5, LG6, SCN4).

A ``VersionedFolder`` whose runs hold::

    keys/bucket=<b>/    (key): the request identities of a crawl, sorted
    filter/             (block, word): a blocked Bloom filter of the run's keys

A probe first meets the filter, then the keys.  The filter gives a key one
64-bit word (its block) and four bits in it; a word is the OR of its keys'
masks.  Probing joins 16-byte rows on the block number, where the exact join
moves whole URLs, and a probe whose bits are not all set is new for certain.
Only the others look the keys up, and only in their buckets' folders.  The
answer is exact: a false hit of the filter finds no key.

``add`` writes only keys that are new, so a run's keys are disjoint from the
others'; ``compact`` makes one run, and one filter, of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .links import canonical
from .sizing import broadcast_if_small
from .versions import VersionedFolder, new_run

BUCKETS = 64
BITS_PER_KEY = 16

_KEYS = "key string, bucket int"
_FILTER = "block bigint, word bigint"


def _mask(key: Column) -> Column:
    """Four of 64 bits, from one hash."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                    F.call_function("shiftrightunsigned", h, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks).cast("bigint"))


class SeenSet(VersionedFolder):
    SETTINGS = ("buckets", "bits")

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = BUCKETS, bits: int = BITS_PER_KEY) -> SeenSet:
        return super().create(spark, path, buckets=buckets, bits=bits)

    def _bucket(self, now: dict) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(now["buckets"])).cast("int")

    def _write(self, keys: DataFrame, now: dict, run: str) -> int:
        """Keys and filter of a run; the number of the filter's blocks."""
        (keys.withColumn("bucket", self._bucket(now)).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
         .write.partitionBy("bucket").parquet(f"{self.path}/{run}/keys"))
        written = self.read_run("keys", _KEYS, {"path": run})
        blocks = max(1, -(-written.count() * now["bits"] // 64))
        (written.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word"))
         .write.parquet(f"{self.path}/{run}/filter"))
        return blocks

    def _keys(self, now: dict) -> DataFrame:
        return self.union([self.read_run("keys", _KEYS, r) for r in now["runs"]], _KEYS)

    def _maybe(self, now: dict, probes: DataFrame) -> DataFrame:
        """The probes (distinct ``key``) that a run's filter lets through."""
        through = []
        for r in now["runs"]:
            words = broadcast_if_small(self.read_run("filter", _FILTER, r))
            p = probes.select("key", _block(F.col("key"), r["blocks"]).alias("block"), _mask(F.col("key")).alias("mask"))
            through.append(p.join(words, "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("key"))
        out = self.union(through, "key string")
        return out if len(through) < 2 else out.distinct()

    def _known(self, now: dict, probes: DataFrame) -> DataFrame:
        """The probes that were seen, exactly."""
        maybe = self._maybe(now, probes).withColumn("bucket", self._bucket(now)).checkpoint()
        hit = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # at most all buckets
        keys = self._keys(now).where(F.col("bucket").isin(hit))
        return maybe.join(keys, ["bucket", "key"], "left_semi").select("key")

    def add(self, batch_id: str, urls: DataFrame, url: str = "url") -> bool:
        """Adds the request identities of fetched URLs; False if the batch is in."""
        now = self.manifest()
        if self.holds(now, batch_id):
            return False
        keys = urls.select(canonical(url).alias("key")).where(F.col("key").isNotNull()).distinct()
        if now["runs"]:
            keys = keys.checkpoint()
            keys = keys.join(self._known(now, keys), "key", "left_anti")
        run = new_run()
        self._add_run(now, run, batch_id, blocks=self._write(keys, now, run))
        return True

    def compact(self) -> bool:
        now = self.manifest()
        if len(now["runs"]) < 2:
            return False
        run = new_run()
        self._one_run(now, run, blocks=self._write(self._keys(now).select("key"), now, run))
        return True

    def probe(self, rows: DataFrame, url: str = "url", flag: str = "seen") -> DataFrame:
        """``rows`` with a flag: was the URL's request identity added before?
        A null URL was not."""
        now = self.manifest()
        keyed = rows.withColumn("_key", canonical(url))
        known = self._known(now, keyed.select(F.col("_key").alias("key")).where(F.col("key").isNotNull()).distinct())
        known = known.select(F.col("key").alias("_key"), F.lit(True).alias(flag))
        return keyed.drop(flag).join(known, "_key", "left").select(
            *[c for c in rows.columns if c != flag], F.coalesce(F.col(flag), F.lit(False)).alias(flag))

    def unseen(self, rows: DataFrame, url: str = "url") -> DataFrame:
        """LG6: the rows whose URL was not seen."""
        return self.probe(rows, url, "_seen").where(~F.col("_seen")).drop("_seen")

    def filter_report(self, rows: DataFrame, url: str = "url") -> dict:
        """How many distinct probes there were, how many the filter answered
        alone, and how many it let through that were new after all."""
        now = self.manifest()
        probes = rows.select(canonical(url).alias("key")).where(F.col("key").isNotNull()).distinct().checkpoint()
        n, through, known = probes.count(), self._maybe(now, probes).count(), self._known(now, probes).count()
        return {"probes": n, "answered": n - through, "false_hits": through - known}
