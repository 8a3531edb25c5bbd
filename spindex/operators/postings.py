"""Inverted index: occurrences, per-URL term counts, document frequency and the
nested token view (TX7, TX10, AG2, AG3, SNK4).

The index is kept **flat**: ``postings(token, url, count)``.  A token's
postings are never gathered into one row by the operators that build or
query the index; the nested view (AG3) is split into bounded chunks.

Plan shape of ``term_counts`` (stem on):

    scan(text) -> words, checkpointed as one string per text
      -> explode
      -> join vocabulary(word -> stem)       [vocabulary: distinct words,
                                              stemmed once, checkpointed, stop
                                              stems removed; broadcast after a
                                              size check, so the occurrences
                                              stay where they are; a larger
                                              one is hashed per partition of a
                                              shuffle, with AQE's skew split]
      -> dealt by (token, url) to as many tasks as the texts' size asks for
      -> count by (token, url)

Texts are tokenised once and stemming runs once per distinct word.  The
occurrences are not counted per word before the join: most words of a text
occur once or twice in it, and a count by (url, word) is one more shuffle.
For the same reason, and because such counts hold most pairs of a task's texts
in memory, they are not counted before they are dealt out either.  The tasks
that count grow in number with the texts, whatever number of shuffle
partitions the session has, so that the pairs of one task do not grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import porter, text
from ..session import checkpoint_dir
from .sizing import fits

POSTINGS_COLUMNS = ("token", "url", "count")

#: Bytes of text whose words one task counts: about half a million pairs.
COUNT_BYTES = 8 << 20


def _nonnull(df: DataFrame, col: str) -> DataFrame:
    """Rows of an ``explode_outer`` that carry an element.

    The ``_outer`` generators are used on purpose: for a plain explode Spark
    infers ``size(array) > 0`` and pushes it below the projection, which
    evaluates the whole tokeniser (or link resolver) a second time per row."""
    return df.filter(F.col(col).isNotNull())


def occurrences(corpus: DataFrame, stem: bool = True, key: str = "url",
                text_col: str = "text") -> DataFrame:
    """One row per token occurrence: (key, pos, token).  ``pos`` is the word's
    position among the kept ASCII words, so text order can be rebuilt."""
    if not stem:
        return _nonnull(corpus.select(key, F.posexplode_outer(text.tokens(text_col)).alias("pos", "token")),
                        "token")
    words = _nonnull(corpus.select(key, F.posexplode_outer(text.ascii_lower_words(text_col))
                                   .alias("pos", "word")), "word")
    vocab = indexable_stems(stem_vocabulary(words.select("word")))
    return words.join(vocab, "word").select(key, "pos", F.col("stem").alias("token"))


def stem_vocabulary(words: DataFrame, word: str = "word") -> DataFrame:
    """TX7: distinct words -> (word, stem), checkpointed.

    Work grows with the vocabulary, not the text.  The table is written to
    the shared checkpoint folder: it is read by a join right after, and the
    written table is a leaf for the optimizer, so no later predicate is
    pushed into (and re-evaluates) the stemmer expression."""
    checkpoint_dir(words.sparkSession)
    vocab = words.select(F.col(word).alias("word")).distinct()
    return porter.stem_steps(vocab, "word", "stem").select("word", "stem").checkpoint()


def indexable_stems(vocab: DataFrame) -> DataFrame:
    """TX6 after stemming: vocabulary rows whose stem is not a stop word."""
    return vocab.filter(~text.is_stop_word(F.col("stem")))


def count_parts(texts: DataFrame, text_col: str = "text") -> int:
    """Tasks that count the words of the texts, by their size.  The texts are
    read once to measure them, so they should be stored."""
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // COUNT_BYTES))


def term_counts(corpus: DataFrame, stem: bool = True, key: str = "url",
                text_col: str = "text", parts: int | None = None) -> DataFrame:
    """TX10 / M3(a): postings ``(token, url, count)`` of a corpus ``(key, text)``,
    dealt by (token, url) to ``parts`` tasks (``count_parts`` by default: the
    words are then stored, to be measured)."""
    spaced = corpus.select(F.col(key).alias("url"), text.spaced(text_col).alias("words"))
    if stem or parts is None:
        # the words are read for their size, the vocabulary and the counts
        checkpoint_dir(corpus.sparkSession)
        spaced = spaced.checkpoint()
    parts = parts or count_parts(spaced, "words")
    words = _word_rows(spaced)
    if stem:
        vocab = indexable_stems(stem_vocabulary(words.select("word")))
        vocab = F.broadcast(vocab) if fits(vocab) else vocab.hint("shuffle_hash")
        toks = words.join(vocab, "word").select(F.col("stem").alias("token"), "url")
    else:
        toks = words.filter(~text.is_stop_word(F.col("word"))).select(F.col("word").alias("token"), "url")
    return (toks.repartition(parts, "token", "url")
            .groupBy("token", "url").agg(F.count(F.lit(1)).alias("count"))
            .select(*POSTINGS_COLUMNS))


def _word_rows(spaced: DataFrame) -> DataFrame:
    """(url, word) of every ASCII word of ``text.spaced`` strings, lowercased.
    Words are tested row by row, in generated code; the empty word is a stop word."""
    parts = spaced.select("url", F.explode_outer(F.split("words", " ")).alias("_w"))
    return parts.filter((F.col("_w") != "") & text.is_ascii("_w")).select("url", F.lower("_w").alias("word"))


def doc_frequency(postings: DataFrame) -> DataFrame:
    """AG2: number of URLs per token (length of the token's URL list)."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("doc_freq"))


def forward_index(postings: DataFrame, url: str | None = None) -> DataFrame:
    """SCN7: the tokens of a URL (or of every URL) with their counts."""
    p = postings if url is None else postings.filter(F.col("url") == url)
    return p.select("url", "token", "count")


def nested_view(postings: DataFrame, part_digits: int = 0, parts: int | None = None) -> DataFrame:
    """AG3: token -> array<struct<url, count>> sorted by url.

    ``part_digits=0``: the reference's form, one row per token.  Such a row
    grows with the token's documents, so for large corpora a token's list is
    split by the first ``part_digits`` hex digits of md5(url): 16 ** digits
    parts for every token, whatever the size of the data.  The flat postings
    stay the form that is stored and searched.  ``parts``: the tasks that the
    lists are dealt to; None leaves their number to the session."""
    part = F.substring(F.md5(F.col("url").cast("binary")), 1, part_digits)
    rows = postings.select("token", part.alias("part"), "url", "count")
    if parts is not None:
        rows = rows.repartition(parts, "token", "part")
    return (rows.groupBy("token", "part")
            .agg(F.array_sort(F.collect_list(F.struct("url", "count"))).alias("urls")))


def merge_postings(existing: DataFrame, delta: DataFrame, parts: int | None = None) -> DataFrame:
    """M3: the upsert as algebra -- counts of the same (token, url) add up.
    ``parts``: the tasks that the pairs are dealt to, which costs no shuffle
    where both sides lie so already; None leaves their number to the session."""
    rows = existing.select(*POSTINGS_COLUMNS).unionByName(delta.select(*POSTINGS_COLUMNS))
    if parts is not None:
        rows = rows.repartition(parts, "token", "url")
    return (rows.groupBy("token", "url").agg(F.sum("count").alias("count"))
            .select(*POSTINGS_COLUMNS))


def tokens_column(corpus: DataFrame, key: str = "url", text_col: str = "text",
                  stem: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """SNK4 (upload switch off): tokens stay on the row as an array, in text
    order, after the columns ``key`` and ``keep``.  Without stemming it is one projection; with stemming it goes
    through ``occurrences`` (vocabulary job) and ``array_sort`` on
    (pos, token) restores the order -- one document per group, so each group
    is bounded by the size of one text."""
    if not stem:
        return corpus.select(key, *keep, text.tokens(text_col).alias("tokens"))
    # rows are told apart by content, not by key: the same URL may hold two
    # texts; rows equal in both share one token list
    row = F.sha2(F.to_json(F.struct(F.col(key).alias("k"), F.col(text_col).alias("t"))), 256)
    rows = corpus.select(key, text_col, *keep, row.alias("_row"))
    occ = occurrences(rows.dropDuplicates(["_row"]), stem=stem, key="_row", text_col=text_col)
    per_row = (occ.groupBy("_row")
               .agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t")))
    return (rows.select(key, *keep, "_row").join(per_row, "_row", "left")
            .select(key, *keep, F.coalesce(F.transform("_t", lambda s: s["token"]),
                                    F.array().cast("array<string>")).alias("tokens")))
