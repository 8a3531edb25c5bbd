"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its key and its text.  A source that must give fewer
words than it has keeps the documents below a hash threshold, one that must
give more keeps all of them and repeats those below a threshold.  A threshold
is found without sorting documents: words are summed by (source, bucket of the
leading hash bits), the running sum over at most 4,096 buckets tells in which
bucket the budget ends, and only that bucket is summed again by the next bits.
After five levels a bucket is a single hash value.  Budgets are nested: a
source that has documents twice below a larger budget has them below a smaller.

Rows that share key and text share the hash, hence the decision; rows of one
key, or of none, with different texts are decided one by one.  The document at
the boundary is taken when that comes closer to the budget.  A null key or
text hashes as the empty string, a null text has size 0, and null is a source
of its own, last in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, stored

BITS, LEVELS = 12, 5
WEIGHTS = (5, 2, 1)


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: str, text: str) -> Column:
    """The first 60 bits of md5 of the key as text, a colon and the text's md5."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    hexed = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per
    source.  Weights repeat along the sources by code point, null last.  With
    sources ordered by cap / weight, those that reach their cap (``most``
    times their size) come first; the rest share what is left by weight."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    filled = Window.orderBy("ratio", F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.select(
        "source", "source_size",
        F.element_at(cycle, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")).cast("double").alias("w"))
    ranked = ranked.select(
        "*", (F.col("source_size") * F.lit(float(most))).alias("cap"),
        (F.col("source_size") * F.lit(float(most)) / F.col("w")).alias("ratio"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"))
    ranked = ranked.select(
        "*", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("w").over(filled.rowsBetween(0, Window.unboundedFollowing)).alias("left_w"))
    # the level if this source and those after it shared what is left
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("before")) / F.col("left_w"))
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", F.col("source").isNull(), "source", "level"))
                 ).over(everything)
    return ranked.select("source", "source_size", F.coalesce(
        F.least("cap", F.col("w") * free["level"]), F.col("cap")).alias("target"))


def _thresholds(base: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, cut``: documents with hash < cut fill the source's budget."""
    spans = budgets.select("source", "budget", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = base.alias("b").join(spans.alias("s"), F.expr(
            f"b.source <=> s.source AND shiftright(b.h, {shift + BITS}) = shiftright(s.lo, {shift + BITS})"
            if level else "b.source <=> s.source"))
        histogram = inside.groupBy("b.source", "s.budget", "s.below", F.shiftright("b.h", shift).alias("bucket")).agg(
            F.sum("b.size").alias("words"))
        by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = histogram.withColumn("upto", F.col("below") + F.sum("words").over(by))
        # the first bucket that passes the budget
        spans = run.where(F.col("upto") > F.col("budget")).groupBy("source").agg(
            F.min_by(F.struct("budget", F.shiftleft("bucket", shift).alias("lo"),
                              (F.col("upto") - F.col("words")).alias("below"), "words"), "bucket").alias("x")
        ).select("source", "x.*")
    closer = (F.col("below") + F.col("words") - F.col("budget")) < (F.col("budget") - F.col("below"))
    return spans.select("source", F.when(closer, F.col("lo") + 1).otherwise(F.col("lo")).alias("cut"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of ``docs``: ``key, source, size, source_size, target,
    copies`` (how often the mix has the document), ``taken`` (copies x size) and
    ``hash`` (:func:`hash_of`)."""
    base = stored(docs.select(F.col(key).alias("k"), F.col(source).alias("source"), hash_of(key, text).alias("h"),
                              size_of(text).alias("size")), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stored(targets(sizes, share, most, weights), "targets")
    # a target of t sizes is floor(t) whole rounds and a budget for the rest
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("whole", rounds.cast("long"))
    budgets = goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    cuts = _thresholds(base, budgets)
    plan = goal.alias("g").join(cuts.alias("c"), F.expr("g.source <=> c.source"), "left").select(
        "g.*", F.coalesce("c.cut", F.lit(0)).alias("cut"))
    copies = F.least(F.col("p.whole") + F.when(F.col("b.h") < F.col("p.cut"), 1).otherwise(0), F.lit(most)).cast("long")
    return base.alias("b").join(plan.alias("p"), F.expr("b.source <=> p.source")).select(
        F.col("b.k").alias(key), F.col("b.source").alias("source"), F.col("b.size").alias("size"),
        F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), copies.alias("copies"),
        (copies * F.col("b.size")).alias("taken"), F.col("b.h").alias("hash"))


def apply(docs: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix` says.  Rows
    of one hash and source have one number of copies."""
    copies = plan.groupBy(F.col("hash").alias("of"), F.col("source").alias("from")).agg(F.max("copies").alias("copies"))
    rows = packed(docs, hash_of(key, text).alias("h"), F.col(source).alias("s")).join(
        copies, (F.col("h") == F.col("of")) & F.col("s").eqNullSafe(F.col("from")))
    repeated = rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("row.*")
