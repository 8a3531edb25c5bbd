"""Ranked lexical search over a length-stratified index.

A document's score for an item sums ``w * ((10^9 * tf) div (1000 * tf + 20 * m))``
over the item's terms; its length enters through the integer normaliser ``m``
alone.  Documents of equal ``m`` form a *stratum*, and within a stratum a
posting's impact depends on nothing but its ``tf``.

Index: rows are blocks of a stratum, cut at ``BLOCK`` documents or
``POSTINGS`` postings, so that a stratum with any number of documents (copies of
one text, say) is many rows, dealt out over tasks.  A block holds its documents'
ids, its terms, and per term the postings by falling ``tf``; runs of equal
``tf`` share one impact, so impacts are computed once per ``tf`` and block.

Search: the first posting of a term gives its largest impact in the block, and
the sum over an item's terms bounds every score there.  A task visits the
blocks it reads in the order of an item's bounds and stops at the first that is
below the item's k-th score so far; equal bounds are visited, as a smaller id
may win a tie.  Tasks hand on at most k rows per item, which are ranked.

Terms are the maximal runs of ASCII letters and digits and of all other
characters above U+007F, of the whole text; only A-Z are lower-cased.  Where the
items' vocabulary has at most ``VOCABULARY`` bytes, it is sent to the tasks that
read the texts and only its postings are indexed (results are the same);
numbers and lengths of documents always count all terms.  Items are searched in
groups of about ``PAIRS`` item-term pairs: a bound on what the driver holds.

Null and empty texts have no terms and are no documents.  Every row is a
document of its own; rows with a null id rank last among equal scores.  Items of
equal id are one item with the terms of all; an item without terms, or whose
terms no document holds, has no rows.  Empty tables give an empty result.  Only
the named columns are read; document ids are integers.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, freeing, partitions, stored

TOP = 50
BLOCK, POSTINGS = 1024, 200_000
VOCABULARY = 32 << 20
PAIRS = 500_000

_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def split_terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_BYTES).split()


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _counter(wanted):
    """Counts the terms of texts; ``wanted`` (a broadcast set) or all are kept."""
    def each(batches):
        keep = wanted.value if wanted is not None else None
        for batch in batches:
            at, n, terms, tfs = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                words = split_terms(text) if text else ()
                if not words:
                    continue
                found = Counter(words)
                if keep is not None:
                    found = {t: found[t] for t in found.keys() & keep}
                at.append(i)
                n.append(len(words))
                terms.append([t.decode() for t in found])
                tfs.append(list(found.values()))
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())),
                     pa.array(tfs, pa.list_(pa.int64()))], names=["id", "n", "terms", "tfs"])
    return each


def count_terms(docs: DataFrame, key: str, text: str, wanted=None) -> DataFrame:
    """``id, n, terms, tfs`` per row that has a term."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        freeing(_counter(wanted)), f"id {kind}, n long, terms array<string>, tfs array<long>")


# ------------------------------------------------------------------- index

def _invert(m: int, ids: pa.Array, terms: pa.ListArray, tfs: pa.ListArray) -> pa.RecordBatch:
    """One block of documents as an index row."""
    flat = terms.flatten().dictionary_encode()
    words = flat.dictionary
    order = np.argsort(np.argsort(words.to_numpy(zero_copy_only=False).astype(object), kind="stable"), kind="stable")
    code = order[flat.indices.to_numpy()]  # terms by name
    tf = tfs.flatten().to_numpy()
    doc = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
    by = np.lexsort((doc, -tf, code))
    start = np.searchsorted(code[by], np.arange(len(words) + 1))
    packed = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int64()), one(ids), one(words.take(pa.array(np.argsort(order)))), packed(start, "<i4"),
         packed(tf[by], "<i8"), packed(doc[by], "<i4")], names=["m", "ids", "terms", "start", "tf", "doc"])


def _blocks(block: int, postings: int):
    def each(batches):
        open_, m, n = [], None, 0

        def close():
            t = pa.concat_tables(open_).combine_chunks()
            cols = [t.column(c).chunk(0) for c in ("id", "terms", "tfs")]
            return _invert(m, *cols)

        for batch in batches:
            if not batch.num_rows:
                continue
            ms = batch.column("m").to_numpy()
            sizes = batch.column("terms").value_lengths().to_numpy()
            s = 0
            for i in range(len(ms)):
                if open_ or s < i:
                    full = sum(t.num_rows for t in open_) + i - s >= block or n + sizes[i] > postings
                    if ms[i] != m or full:
                        if s < i:
                            open_.append(pa.Table.from_batches([batch.slice(s, i - s)]))
                        yield close()
                        open_, n, s = [], 0, i
                m, n = int(ms[i]), n + int(sizes[i])
            open_.append(pa.Table.from_batches([batch.slice(s)]))
        if open_:
            yield close()
    return each


class StratifiedIndex:
    """``blocks`` (stored rows ``m, ids, terms, start, tf, doc``), the number
    ``n_docs`` and ``length`` of all documents, and ``df`` (term, df)."""

    def __init__(self, blocks: DataFrame, df: DataFrame, n_docs: int, length: int):
        self.blocks, self.df, self.n_docs, self.length = blocks, df, n_docs, length

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted=None, block: int = BLOCK,
          postings: int = POSTINGS) -> StratifiedIndex:
    """Indexes every row of ``docs``; with ``wanted`` (a broadcast set of
    terms) the postings of other terms are left out."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    with bounded_batches(spark, 512):
        forward = stored(count_terms(docs, key, text, wanted), "forward", codec="zstd")
        total = forward.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        df = stored(forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
        # copies of a text share m: a second key deals them out
        strata = (forward.where(F.size("terms") > 0)
                  .withColumn("m", F.expr(f"50 + (50L * n * {total['n']}L) div {max(total['l'], 1)}L"))
                  .withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
                  .repartitionByRange(partitions(spark), "m", "deal").sortWithinPartitions("m", "deal"))
        blocks = stored(strata.select("m", "id", "terms", "tfs").mapInArrow(
            freeing(_blocks(block, postings)),
            f"m long, ids array<{kind}>, terms array<string>, start binary, tf binary, doc binary"),
            "strata", codec="zstd", group_bytes=8 << 20)
    return StratifiedIndex(blocks, df, total["n"], total["l"])


# ------------------------------------------------------------------ search

class _Best:
    """The k best of an item so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int:
        """A score must reach this to matter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if len(score) > self.k:
            fine = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, null = score[fine], ids[fine], null[fine]
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.null, null)))
        by = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[by], ids[by], null[by]


class _Block:
    """A read index row, and where the items' terms are in it."""

    def __init__(self, row: dict, places: dict[str, int], n_terms: int):
        self.ids = row["ids"]
        self.start = np.frombuffer(row["start"], "<i4")
        self.doc = np.frombuffer(row["doc"], "<i4")
        tf = np.frombuffer(row["tf"], "<i8")
        top = int(tf.max())
        if top <= 4 * len(tf):  # one impact per tf
            self.value = impact(np.arange(top + 1), row["m"])[tf]
        else:
            each, place = np.unique(tf, return_inverse=True)
            self.value = impact(each, row["m"])[place]
        self.at = np.full(n_terms, -1)
        known = [(places[t], i) for i, t in enumerate(row["terms"].to_pylist()) if t in places]
        if known:
            mine, here = np.array(known).T
            self.at[mine] = here
        self.most = np.zeros(n_terms, np.int64)
        has = self.at >= 0
        self.most[has] = self.value[self.start[self.at[has]]]

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at = self.at[terms]
        weights, at = weights[at >= 0], at[at >= 0]
        lo = self.start[at].astype(np.int64)
        n = self.start[at + 1] - lo
        ends = np.cumsum(n)
        index = np.repeat(lo - (ends - n), n) + np.arange(ends[-1])
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.doc[index], np.repeat(weights, n) * self.value[index])
        return out


def _searcher(state, k: int, stats=None):
    """``state`` (broadcast): places of the terms, item bounds in the pair
    arrays, the pairs' terms and weights, the item ids and their type."""
    def each(batches):
        places, item, terms, weights, keys, kind = state.value
        n_items = len(item) - 1
        best = [_Best(k) for _ in range(n_items)]
        for batch in batches:
            blocks = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                row |= {"m": row["m"].as_py(), "ids": row["ids"].values, "terms": row["terms"].values}
                row |= {c: row[c].as_buffer() for c in ("start", "tf", "doc")}
                blocks.append(_Block(row, places, len(places)))
            if not blocks:
                continue
            bounds = np.stack([np.add.reduceat(weights * b.most[terms], item[:-1]) for b in blocks], 1)
            ids = [(b.ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                    b.ids.is_null().to_numpy(zero_copy_only=False)) for b in blocks]
            order = np.argsort(-bounds, 1, kind="stable")
            for q in range(n_items):
                t, w = terms[item[q]:item[q + 1]], weights[item[q]:item[q + 1]]
                for b in order[q]:
                    if bounds[q, b] < best[q].least():
                        break
                    if stats is not None:
                        stats.add(1)
                    score = blocks[b].scores(t, w)
                    who = np.flatnonzero(score >= best[q].least())
                    if len(who):
                        best[q].add(score[who], ids[b][0][who], ids[b][1][who])
        for q in range(n_items):
            if len(best[q].score):
                n = len(best[q].score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[q]] * n, kind), pa.array(best[q].id, mask=best[q].null), pa.array(best[q].score)],
                    names=["item", "id", "score"])
    return each


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item, term``: the distinct terms of each item id, stored."""
    with bounded_batches(items.sparkSession, 512):
        found = count_terms(items, key, text).select(F.col("id").alias("item"), F.explode("terms").alias("term"))
        return stored(found.distinct(), "item_terms")


def search(index: StratifiedIndex, pairs: DataFrame, k: int = TOP, group: int = PAIRS, item_key: str = "item_id",
           key: str = "doc_id", stats=None) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item of
    :func:`item_terms`."""
    spark = pairs.sparkSession
    item_type, id_type = pairs.schema["item"].dataType, index.blocks.schema["ids"].dataType.elementType
    groups = max(1, -(-pairs.count() // group))
    kind = {"item": item_type.simpleString(), "id": id_type.simpleString()}
    found = spark.createDataFrame([], f"item {kind['item']}, id long, score long")
    weighted = pairs.join(index.df, "term")
    for g in range(groups):
        mine = weighted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect()
        by: dict = {}
        for r in mine:
            if (w := index.weight(r["df"])) > 0:
                by.setdefault(r["item"], []).append((r["term"], w))
        if not by:
            continue
        places = {t: i for i, t in enumerate(sorted({t for ts in by.values() for t, _ in ts}))}
        bounds = np.concatenate([[0], np.cumsum([len(ts) for ts in by.values()])])
        terms = np.array([places[t] for ts in by.values() for t, _ in ts])
        weights = np.array([w for ts in by.values() for _, w in ts], np.int64)
        state = spark.sparkContext.broadcast((places, bounds, terms, weights, list(by), to_arrow_type(item_type)))
        with bounded_batches(spark, 32):
            found = found.unionByName(stored(index.blocks.mapInArrow(
                freeing(_searcher(state, k, stats)), f"item {kind['item']}, id long, score long"), "found"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.col("item").alias(item_key), "rank", F.col("id").cast(id_type).alias(key), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text",
         item_key: str = "item_id", item_text: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """Indexes ``docs`` and ranks them for every row of ``items``."""
    pairs = item_terms(items, item_key, item_text)
    terms = pairs.select("term").distinct()
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 1), F.lit(0)).alias("n")).first()["n"]
    wanted = None
    if size <= vocabulary:
        wanted = docs.sparkSession.sparkContext.broadcast({r["term"].encode() for r in terms.collect()})
    return search(build(docs, key, text, wanted), pairs, k, item_key=item_key, key=key)
