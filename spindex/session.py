"""Session helpers.

Operators never create a session; they take DataFrames.  These helpers are
for tests, bench and the entry module.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "spindex") -> SparkSession:
    """A local session configured like the cluster one (AQE on, UTC, no UI)."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cores
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # written intermediates (vocabulary, index, top-k) are deleted once
        # the DataFrame that reads them is garbage collected on the driver
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SPINDEX_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Settings the operators rely on; safe to call on any session."""
    conf = spark.conf
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session (tests, bench) without that setting gets a fresh
    scratch folder; on a cluster the setting is required, because executors
    must all see the folder and survive the loss of any one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="spindex-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and a function that makes its paths:
    small bookkeeping files lie in the same store as the tables."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, make = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(make(path))] if fs.exists(make(path)) else []


def file_stamps(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of a file, or of the files of a folder."""
    fs, make = file_system(spark, path)
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(make(path)))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, make = file_system(spark, path)
    return fs.exists(make(path)) and fs.getFileStatus(make(path)).isDirectory()


def read_text(spark: SparkSession, path: str) -> str:
    fs, make = file_system(spark, path)
    stream = fs.open(make(path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, content: str) -> None:
    """Writes a small file that must not exist yet; it appears complete or not at all."""
    fs, make = file_system(spark, path)
    target, part = make(path), make(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(part, False)
    stream.write(bytearray(content.encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(path)
