"""Rows clustered by time, with per-file bounds that let a range skip files (SCN5).

A ``VersionedFolder`` whose runs hold::

    rows/      the rows of a set of batches, dealt out and sorted by time
    files/     (file, low, high, n): the time bounds of each of those files

A range reads the small table of files first and then only the files whose
bounds meet the range; inside a file the sorted rows let Parquet's own row-group
statistics skip once more.  Batches that arrive in any order overlap in time;
``compact`` sorts all of them into one run, after which ranges are disjoint but
for equal times.  Rows without a time lie in a file of their own kind: no range
reads them, ``rows`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scans import time_range
from .versions import VersionedFolder, new_run

ROWS_PER_FILE = 1_000_000


class TimeTable(VersionedFolder):
    SETTINGS = ("time", "schema", "per_file")

    @classmethod
    def create(cls, spark: SparkSession, path: str, like: DataFrame, time: str, per_file: int = ROWS_PER_FILE) -> TimeTable:
        """An empty table of the columns of ``like``, clustered by its column ``time``."""
        schema = ", ".join(f"`{c}` {kind}" for c, kind in like.dtypes)
        return super().create(spark, path, time=time, schema=schema, per_file=per_file)

    def _write(self, rows: DataFrame, now: dict, run: str) -> None:
        t = F.col(now["time"])
        target = f"{self.path}/{run}/rows"
        dated = rows.where(t.isNotNull()).repartitionByRange(t).sortWithinPartitions(t)
        dated.write.option("maxRecordsPerFile", now["per_file"]).parquet(target)
        rows.where(t.isNull()).write.mode("append").option("maxRecordsPerFile", now["per_file"]).parquet(target)
        (self.spark.read.schema(now["schema"]).parquet(target).groupBy(F.col("_metadata.file_path").alias("file"))
         .agg(F.min(t).alias("low"), F.max(t).alias("high"), F.count(F.lit(1)).alias("n"))
         .write.parquet(f"{self.path}/{run}/files"))

    def add(self, batch_id: str, rows: DataFrame) -> bool:
        now = self.manifest()
        if self.holds(now, batch_id):
            return False
        run = new_run()
        self._write(self.spark.createDataFrame([], now["schema"]).unionByName(rows), now, run)
        self._add_run(now, run, batch_id)
        return True

    def compact(self) -> bool:
        now = self.manifest()
        if len(now["runs"]) < 2:
            return False
        run = new_run()
        self._write(self.rows(), now, run)
        self._one_run(now, run)
        return True

    def rows(self) -> DataFrame:
        now = self.manifest()
        return self.union([self.read_run("rows", now["schema"], r) for r in now["runs"]], now["schema"])

    def files(self) -> DataFrame:
        now = self.manifest()
        kind = dict(self.spark.createDataFrame([], now["schema"]).dtypes)[now["time"]]
        schema = f"file string, low {kind}, high {kind}, n bigint"
        return self.union([self.read_run("files", schema, r) for r in now["runs"]], schema)

    def between(self, start: str, end: str) -> DataFrame:
        """The rows with ``start <= time < end``, from the files that can hold any."""
        now = self.manifest()
        files = self.files()
        kind = files.schema["low"].dataType
        hit = files.where((F.col("high") >= F.lit(start).cast(kind)) & (F.col("low") < F.lit(end).cast(kind)))
        paths = [r["file"] for r in hit.select("file").collect()]  # the files to be read, as a scan's listing has them
        if not paths:
            return self.spark.createDataFrame([], now["schema"])
        return time_range(self.spark.read.schema(now["schema"]).parquet(*paths), now["time"], start, end)
