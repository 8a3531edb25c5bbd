"""Removal of repeated passages of whole lines, in DataFrame functions only.

The rule: a line goes if it is one of two neighbouring lines, not both white
space, that occurred together earlier, by (key, position in the text), or if it
has ``min_words`` words or more and occurred earlier itself.  A run of lines that
recurs is made of such pairs, wherever it begins or ends, so no part of it is
missed; the first occurrence is never removed.  Shorter single lines that recur
are ordinary text ("Yes.", "* * *", a heading); ``min_words=1`` removes them too.

Content-defined chunks do most of the work.  A line's hash is the leading 32
bits of its md5, and a chunk ends after a line where the rolling hash over the
last two line hashes is 0 modulo ``DIVISOR`` (and at the end of the text): the
boundary depends on the lines around it alone, so a passage is cut the same way
wherever it is shifted.  Chunks of two lines or more that occur more than once
in the table are found by a hash of 8 bytes and their length, and compared byte
by byte.  Every occurrence but the first goes with all pairs inside it; only
narrow rows of chunks move for that, however long the passages are.

What is left, the pairs across a boundary, those of chunks that are a first
occurrence, and long lines, extends the chunks to both sides, line by line: each
is looked up by the SHA-256 of its bytes.  The first occurrence of a pair
is never inside a removed chunk, so the two steps decide as the rule says.

A null text stays null with 0 lines.  Rows that share key and text are one
document here: they lose the same lines, and none because of each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from .common import stored

DIVISOR = 3
MIN_WORDS = 50

_NOT_SPACE = r"[^\x20\x09-\x0D]"


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """``k, h`` (hash of the text), ``start`` (the number of its first line), ``body`` per
    chunk.  Each line of a body is led by the letter L: with a line C put after
    every boundary, splitting at those lines is unambiguous, and no step looks
    into an array by position."""
    split = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.split(F.col(text), "\n", -1).alias("lines"))
    hashes = F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
    closes = F.zip_with("lh", F.concat(F.array(F.lit(0).cast("long")), "lh"), lambda a, b: (a + b * 31) % divisor == 0)
    marked = F.array_join(F.zip_with("lines", "closes", lambda x, c: F.concat(
        F.lit("L"), x, F.when(c, "\nC").otherwise(""))), "\n")
    ends = F.filter(F.transform("closes", lambda c, i: F.when(c, (i + 1).cast("long"))), lambda i: i.isNotNull())
    text = (split.withColumn("lh", hashes).withColumn("closes", closes)
            .select("k", "h", F.concat(F.array(F.lit(0).cast("long")), ends).alias("starts"), marked.alias("m")))
    # a boundary after the last line opens no chunk
    cut = text.select("k", "h", "starts", F.split(F.regexp_replace("m", r"\nC\z", ""), "\nC\n", -1).alias("bodies"))
    return (cut.select("k", "h", F.explode(F.arrays_zip("starts", "bodies")).alias("c")).where("c.bodies IS NOT NULL")
            .select("k", "h", F.col("c.starts").alias("start"), F.col("c.bodies").alias("body")))


def _count(body: Column) -> Column:
    """Lines of a chunk."""
    return (F.length(body) - F.length(F.replace(body, F.lit("\n"))) + 1).cast("long")


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = DIVISOR,
                    hashed: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """``k, h, start, n`` of every chunk of two lines or more, not all white
    space, whose bytes occurred earlier."""
    body = F.col("body")
    chunks = (chunked(docs, key, text, divisor).withColumn("n", _count(body)).where("n > 1")
              .where(body.rlike(rf"(?dm)^L[\x20\x09\x0B-\x0D]*{_NOT_SPACE}"))
              .withColumn("digest", hashed("body")).withColumn("bytes", F.octet_length("body")))
    at = F.struct("k", "h", "start")
    found = stored(chunks.select("k", "h", "start", "n", "digest", "bytes"), "chunks")
    by = ["digest", "bytes"]
    twice = lambda df, *keys: df.groupBy(*keys).agg(F.min(at).alias("first"), F.max(at).alias("last")).where(
        ~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    # written, so that the joins below are of plain scans, which may be split at a hot digest
    suspects = stored(twice(found, *by), "suspects")
    # the bytes of suspects: one body per digest and task moves
    bodies = chunks.join(broadcast_if_small(suspects.select(*by)), by, "left_semi")
    compared = stored(bodies.groupBy(*by).agg((F.min("body") == F.max("body")).alias("same")), "compared")
    equal = suspects.join(compared.where("same").select(*by), by, "left_semi")
    gone = found.join(equal, by).where(~at.eqNullSafe(F.col("first"))).select("k", "h", "start", "n")
    collided = compared.where("NOT same").select(*by)
    if collided.isEmpty():
        return gone
    # equal hashes of other bytes: grouped by the bytes themselves
    bodies = stored(chunks.join(F.broadcast(collided) if collided.count() < 10_000 else collided, by, "left_semi"), "collided")
    return gone.unionByName(bodies.join(stored(twice(bodies, "body"), "classes"), "body")
                            .where(~at.eqNullSafe(F.col("first"))).select("k", "h", "start", "n"))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``k, h`` (hash of the text), ``no`` (of the first line), ``lines`` (1 or 2) and ``digest`` of
    every line of ``min_words`` words or more and of every pair of neighbouring lines."""
    split = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"),
                        F.split(F.col(text), "\n", -1).alias("lines"))
    after = F.concat(F.expr("slice(lines, 2, size(lines))"), F.array(F.lit(None).cast("string")))
    rows = split.select("k", "h", F.posexplode(F.zip_with("lines", after, lambda x, y: F.struct(
        x.alias("x"), y.alias("y")))).alias("no", "p")).select("k", "h", F.col("no").cast("long").alias("no"), "p.x", "p.y")
    # anchored and possessive: one look at the line
    long = F.col("x").rlike(r"\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (min_words - 1))
    filled = F.concat("x", "y").rlike(_NOT_SPACE)  # null after the last line
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    item = lambda n, c: F.struct(F.lit(n).alias("lines"), digest(c).alias("digest"))
    items = F.array(F.when(long, item(1, F.col("x"))), F.when(filled, item(2, F.concat("x", F.lit("\n"), "y"))))
    return rows.select("k", "h", "no", F.explode(items).alias("i")).where("i IS NOT NULL").select(
        "k", "h", "no", "i.lines", "i.digest")


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                   divisor: int = DIVISOR, hashed: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """``key, n_lines, removed_lines, text`` (what is left of it), one row per row of ``docs``."""
    chunks = repeated_chunks(docs, key, text, divisor, hashed)
    # the first lines of the pairs inside removed chunks
    inside = stored(chunks.select(F.col("k").alias("ck"), F.col("h").alias("ch"), F.explode(
        F.sequence("start", F.col("start") + F.col("n") - 2)).alias("cno")), "inside")
    on = F.col("k").eqNullSafe(F.col("ck")) & F.col("h").eqNullSafe(F.col("ch")) & (F.col("no") == F.col("cno"))
    found = stored(passages(docs, key, text, min_words).join(inside, on, "left").select(
        "k", "h", "no", "lines", "digest", F.col("cno").isNotNull().alias("known")), "passages")
    at = F.struct("k", "h", "no")
    rest = found.where("NOT known")
    # seen at two places at least; written, so that a join on it may split a hot digest's rows
    repeated = stored(rest.groupBy("digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where(
        ~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first"), "repeated")
    later = rest.join(repeated, "digest").where(~at.eqNullSafe(F.col("first"))).select("k", "h", "no", "lines")
    gone = (later.unionByName(found.where("known").select("k", "h", "no", "lines"))
            .select("k", "h", F.explode(F.sequence("no", F.col("no") + F.col("lines") - 1)).alias("no"))
            .groupBy("k", "h").agg(F.collect_set(F.col("no").cast("int")).alias("nos")))
    split = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.split(F.col(text), "\n", -1).alias("lines"))
    left = split.alias("d").join(gone.alias("g"), F.col("d.k").eqNullSafe(F.col("g.k")) & F.col("d.h").eqNullSafe(
        F.col("g.h")), "left")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.when(F.col("nos").isNull(), F.col("lines")).otherwise(
        F.transform(F.array_except(every, "nos"), lambda i: F.get("lines", i)))
    known = F.col("lines").isNotNull()
    return left.select(
        F.col("d.k").alias(key), F.when(known, F.size("lines")).otherwise(0).cast("long").alias("n_lines"),
        F.when(F.col("nos").isNotNull(), F.size("nos")).otherwise(0).cast("long").alias("removed_lines"),
        F.array_join(stay, "\n").alias("text"))
