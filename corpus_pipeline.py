"""The corpus pipeline: documents to token ids, in five stages.

Each stage works on all that its predecessor kept and is written and read
again between stages.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.llm import bpe, exact, jaccard, langid, mixing
from spindex.llm.common import packed, stored, table
from spindex.llm.queries import WORD_BPE

#: A document is rejected when its language can't be told: no letter, n-grams
#: that none of the languages has (langid), or a best one-versus-rest score (0 to
#: 1) that speaks clearly against every language.  The best score is 1 / L at
#: least with L languages, so the last can only occur with more than four.
MIN_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified."""
    rows = packed(docs, F.col("text").alias("t"))
    found = langid.annotate(rows, langid.train(docs), text="t", foreign="foreign")
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_SCORE) & ~F.col("foreign")).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact.survivors(docs, exact.dedup(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component (five words, 0.8)."""
    return jaccard.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents, so that the sources' words meet their targets."""
    return mixing.apply(docs, mixing.mix(docs))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed), their number and the hashes of ids and decoded text."""
    return bpe.digests(bpe.encode(docs, WORD_BPE), more=("ids",))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join),
          ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

#: Stages 1 and 5 (a learned model, a tokenizer) can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
