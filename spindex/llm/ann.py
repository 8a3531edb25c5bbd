"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector with ``PROJECTIONS`` Gaussian (2-
stable) projections, shifted and cut into cells of ``WIDTH`` times the mean
norm of the table's vectors.  A query visits its own cell and perturbed ones
(one projection or more moved to the neighbouring interval) in the order of
their estimated success: the sum of squared distances from the query to the
interval borders it would cross.  Vectors and probes of a cell meet in one
group, where the distances to the cell's vectors are one matrix product and
the best are measured again exactly; only those leave the group, so no pairs
are emitted.  The tables' finds are merged and ranked.

A cell of more than ``SLICE`` vectors is dealt out in slices, to each of which
its probes go.  Of identical vectors only the ``k + 1`` smallest ids can be
among a query's k nearest, so no others are indexed; queries with identical
vectors are searched once.  A query that found fewer than ``k`` is compared
with every vector, slice by slice.

Rows whose vector is null, zero, or holds null or non-finite components take
no part.  Vectors meet only vectors of their own dimension.  Rows with a null
id take no part.  Ids are taken to be unique; of repeated ids the nearest
vector counts.  Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freeing, partitions, small_batches, stored

TABLES, PROJECTIONS, WIDTH, PROBES = 8, 6, 2.0, 24
SLICE = 20_000


def projections(dim: int, seed: int, tables: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((tables, dim, m)), rng.random((tables, m))


def cell_key(cells: np.ndarray) -> np.ndarray:
    """One long per row of small integers (rows of any width)."""
    key = np.full(cells.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
    for j in range(cells.shape[-1]):
        key = (key ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0xD1342543DE82EF95)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def probe_order(frac: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The first ``probes`` perturbations, as lists of (projection, step), best
    first.  ``frac`` is the query's place in its interval, 0 to 1, per projection.
    Sets of borders are generated by increasing score with a heap (shift the
    last border to the next, or add the next)."""
    m = len(frac)
    borders = sorted([(float(x) ** 2, j, -1) for j, x in enumerate(frac)]
                     + [(float(1 - x) ** 2, j, 1) for j, x in enumerate(frac)])
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(borders[0][0], (0,))]
    while heap and len(out) < probes:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - borders[last][0] + borders[last + 1][0], chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (score + borders[last + 1][0], chosen + (last + 1,)))
        moves = [(borders[i][1], borders[i][2]) for i in chosen]
        if len({j for j, _ in moves}) == len(moves):  # not both borders of one interval
            out.append(moves)
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, dim, v`` of the rows that take part."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # + 0.0 turns a negative zero into zero, so that equal vectors are equal bytes
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & fine).select(
        F.col(key).cast("long").alias("id"), F.size(v).alias("dim"),
        F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32), pa.array(m.ravel()))


def _by_dim(batch):
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, _matrix(batch.column("v").take(pa.array(at)))


def _hash(rows: DataFrame, width: Column, seed: int, tables: int, m: int, probes: int) -> DataFrame:
    """``t, cell, id, v``: a row per table, and per probe if ``probes`` > 1."""
    def each(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            widths = batch.column("width").to_numpy()
            for d, at, x in _by_dim(batch):
                a, b = projections(d, seed, tables, m)
                place = np.einsum("nd,tdm->tnm", x, a) / widths[at][None, :, None] + b[:, None, :]
                cells = np.floor(place)
                for t in range(tables):
                    if probes <= 1:
                        keys, who = cell_key(cells[t]), np.arange(len(at))
                    else:
                        moved, who = [], []
                        for i in range(len(at)):
                            for moves in probe_order(place[t, i] - cells[t, i], probes):
                                c = cells[t, i].copy()
                                for j, step in moves:
                                    c[j] += step
                                moved.append(c)
                                who.append(i)
                        keys, who = cell_key(np.array(moved)), np.array(who)
                    for s in range(0, len(who), 4096):
                        w = who[s:s + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(w), t, np.int32)), pa.array(np.full(len(w), d, np.int32)),
                             pa.array(keys[s:s + 4096]), pa.array(ids[at[w]]), _lists(x[w])],
                            names=["t", "dim", "cell", "id", "v"])

    return rows.withColumn("width", width).mapInArrow(freeing(each), "t int, dim int, cell long, id long, v array<double>")


def _nearest(k: int):
    """The k nearest of a group's vectors to each of its queries, exactly measured."""
    def each(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and queries.num_rows:
            vcell = np.stack([vectors.column(c).to_numpy() for c in ("cell", "slice")])
            qcell = np.stack([queries.column(c).to_numpy() for c in ("cell", "slice")])
            vorder, qorder = np.lexsort(vcell), np.lexsort(qcell)
            vid, qid = vectors.column("id").to_numpy()[vorder], queries.column("id").to_numpy()[qorder]
            x, q = _matrix(vectors.column("v"))[vorder], _matrix(queries.column("v"))[qorder]
            vc, qc = vcell[:, vorder], qcell[:, qorder]
            ends = np.flatnonzero(np.append((np.diff(qc) != 0).any(0), True)) + 1
            vends = np.flatnonzero(np.append((np.diff(vc) != 0).any(0), True)) + 1
            span = {(int(vc[0, e - 1]), int(vc[1, e - 1])): (s, e) for s, e in zip(np.append(0, vends[:-1]), vends)}
            for s, e in zip(np.append(0, ends[:-1]), ends):
                got = span.get((int(qc[0, s]), int(qc[1, s])))
                if got is None:
                    continue
                y, yid = x[got[0]:got[1]], vid[got[0]:got[1]]
                norm = np.einsum("nd,nd->n", y, y)
                for at in range(s, e, 256):
                    block = q[at:min(at + 256, e)]
                    size = np.einsum("nd,nd->n", block, block)
                    near = size[:, None] + norm[None] - 2 * block @ y.T
                    for i, row in enumerate(near):
                        if len(row) > k:  # what rounding could bring among the k stays
                            limit = np.partition(row, k - 1)[k - 1] + 1e-9 * (size[i] + norm.max())
                            who = np.flatnonzero(row <= limit)
                        else:
                            who = np.arange(len(row))
                        dist = np.sqrt(((y[who] - block[i]) ** 2).sum(1))
                        best = np.lexsort((yid[who], dist))[:k]
                        out.append((np.full(len(best), qid[at + i]), yid[who][best], dist[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query": cols[0], "id": cols[1], "dist": cols[2]})
    return each


def _meet(vectors: DataFrame, queries: DataFrame, k: int, parts: int) -> DataFrame:
    by = ("t", "dim", "part")
    part = F.pmod(F.xxhash64("cell", "slice"), F.lit(parts)).cast("int")
    return (vectors.withColumn("part", part).groupBy(*by)
            .cogroup(queries.withColumn("part", part).groupBy(*by))
            .applyInArrow(_nearest(k), "query long, id long, dist double"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
           tables: int = TABLES, m: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES,
           seed: int = 7, slice_rows: int = SLICE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found in ``vectors`` of
    each row of ``queries`` but the row of the same id, by Euclidean distance."""
    spark = vectors.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    first = Window.partitionBy("dim", "v").orderBy("id")
    base = stored(usable(vectors, key, vector).withColumn("copy", F.row_number().over(first))
                  .where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    asked = stored(usable(queries, key, vector), "queries")
    # identical queries are searched once, under the smallest id
    leaders = stored(asked.groupBy("dim", "v").agg(F.min("id").alias("id")), "leaders")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    widths = base.groupBy("dim").agg((F.avg(norm) * F.lit(float(width))).alias("w"), F.count(F.lit(1)).alias("n"))
    with_width = lambda df: df.join(widths, "dim")
    indexed = stored(_hash(with_width(base), F.col("w"), seed, tables, m, 1), "index")
    cells = indexed.groupBy("t", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    large = cells.where(F.col("n") > slice_rows).select(
        "t", "dim", "cell", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    sliced = indexed.join(large, ["t", "dim", "cell"], "left").select(
        "t", "dim", "cell", "id", "v",
        F.coalesce(F.pmod(F.xxhash64("id"), F.col("slices")), F.lit(0)).cast("int").alias("slice"))
    probing = _hash(with_width(leaders), F.col("w"), seed, tables, m, probes).join(large, ["t", "dim", "cell"], "left").select(
        "t", "dim", "cell", "id", "v", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"))
    best = Window.partitionBy("query").orderBy("dist", "id")
    top = lambda df: (df.groupBy("query", "id").agg(F.min("dist").alias("dist"))
                      .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"))
    found = stored(top(_meet(sliced, probing, k + 1, parts)), "found")
    # queries that found too few: every vector of their dimension, slice by slice
    have = found.groupBy("query").agg(F.count(F.lit(1)).alias("have"))
    short = with_width(leaders).join(have, F.col("id") == F.col("query"), "left").where(
        F.coalesce("have", F.lit(0)) < F.least(F.lit(k + 1), "n"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / slice_rows)).cast("int")
    short = stored(short.select(F.lit(0).alias("t"), "dim", F.lit(0).cast("long").alias("cell"), "id", "v",
                                F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice")), "short")
    everything = with_width(base).select(
        F.lit(0).alias("t"), "dim", F.lit(0).cast("long").alias("cell"), "id", "v",
        F.pmod(F.xxhash64("id"), slices).cast("int").alias("slice"))
    if not short.isEmpty():
        found = top(found.unionByName(_meet(everything, short, k + 1, parts)))
    members = asked.alias("a").join(leaders.alias("l"), (F.col("a.dim") == F.col("l.dim")) & (F.col("a.v") == F.col("l.v"))).select(
        F.col("a.id").alias("query_id"), F.col("l.id").alias("query"))
    own = Window.partitionBy("query_id").orderBy("dist", "id")
    return (members.join(found, "query").where(F.col("id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("dist").alias("score")))
