"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: White space of every contract that counts or normalises words.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for one run, in the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


_TEMPORARY: list[list[str]] = []


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more, and lets the driver
    find the shuffles that went into them unused, so that their files go too."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(conf).delete(p, True)
    gc.collect()
    jvm.System.gc()


@contextmanager
def temporary(spark: SparkSession):
    """Tables stored inside are deleted at the end; the list of their folders is given."""
    _TEMPORARY.append([])
    try:
        yield _TEMPORARY[-1]
    finally:
        delete(spark, *_TEMPORARY.pop())


def stored(df: DataFrame, name: str, codec: str = "snappy", group_bytes: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: the
    lineage ends there, and a lost executor costs no recomputation.  Tables of
    very wide rows ask for small row groups, which bound a reader's batch."""
    path = shared_path(df.sparkSession, name)
    if _TEMPORARY:
        _TEMPORARY[-1].append(path)
    writer = df.write.option("compression", codec)
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``more``: whatever the
    columns are called, names that an operator adds can't clash with them.
    ``select("row.*")`` gives the columns back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``docs`` as ``c0, c1, ...``, and ``more``: like :func:`packed`,
    for plans that read a join's result twice.  (Fields of a struct are pulled
    below the join, differently in each branch, which then share no shuffle.)"""
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], *more)


def original(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of :func:`numbered` under their own names."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their
    Python workers import it without a path of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"  # the driver serves it
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Prepares for Python workers: the package is sent to them, and one Arrow
    batch of whole texts is bounded."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int):
    """Jobs run inside hand Python workers at most ``rows`` rows at a time;
    the session's own setting is back at the end.  The package is sent first."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@cache
def _malloc_trim():
    """glibc's way to hand freed memory back; None where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def free_memory(cycles: bool = True) -> None:
    """Hands unused memory back, Arrow's and what small objects leave in the
    heap: Spark keeps its Python workers, idle ones too, for later stages."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _malloc_trim():
        _malloc_trim()(0)


def freeing(f):
    """A function on a task's batches that frees its memory at the end."""
    def run(batches):
        yield from f(batches)
        free_memory()
    return run


def freeing_group(f):
    """The same for a function on a group's table (groups are many: no search for cycles)."""
    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        free_memory(cycles=False)
        return out
    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(key: str) -> Column:
    """True for rows whose crc32(key as text) mod 4 is 2 (a null key: false)."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False))
