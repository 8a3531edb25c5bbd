"""Vector code compression: product codes with LAESA pruning.

Vectors become integers, ``floor(SCALE * x)``, and are cut into ``PARTS`` equal
consecutive parts.  A part position's codebook starts as that part of the
vectors with the smallest ids; every round assigns each part to its nearest
entry and replaces entries by the floor of their parts' mean.

LAESA: ``PIVOTS`` fixed pivots per part position are chosen once (farthest
first among the initial entries), and each part's distances to them are
computed once and stored beside the vector.  A round computes only the
pivots' distances to its entries.  The largest difference of the two over the
pivots is a lower bound of part-to-entry distance: entries are tried in the
order of their bounds, and a part is done as soon as a bound exceeds the best
exact distance.  Only these trials evaluate the integer distance.  Bounds are
taken in floating point with a margin above their rounding, and equal bounds
are tried, so that assignments (ties to the lower index) are exact.

A round is one scan: tasks send the sums and counts of their entries, not
vectors; 16 sums per component reach the driver, however many vectors there are.

Rows whose vector is null or holds null or non-finite components are dropped.
The vector of the smallest id (null ids last, equal ids by vector) sets the
dimension; rows of another one are dropped, and a dimension that is no
multiple of ``PARTS`` is filled up with zeros.  Components beyond +-65,536 are
set to that bound, so that squared distances fit 64 bits.  With fewer vectors
than ``ENTRIES`` the codebooks are smaller.  Repeated rows are coded alike.  An
empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, freeing, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
PIVOTS = 6
LIMIT = 1 << 28  # of a component, as an integer


def integers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id, label, v`` of the rows that take part; v holds 32-bit integers."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cut = lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    return vectors.where(v.isNotNull() & fine).select(
        F.col(key).alias("id"), F.col(label).alias("label"), F.transform(v.cast("array<double>"), cut).alias("v"))


def cut_parts(v: np.ndarray) -> np.ndarray:
    """(n, d) to (n, PARTS, width), filled up with zeros."""
    return np.pad(v, ((0, 0), (0, -v.shape[1] % PARTS))).reshape(len(v), PARTS, -(-v.shape[1] // PARTS))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two integer matrices; the squares are exact."""
    return np.sqrt(np.stack([((x - row) ** 2).sum(1) for row in y], 1).astype(np.float64))


def choose_pivots(codebook: np.ndarray, pivots: int) -> np.ndarray:
    """(PARTS, pivots, width): farthest-first among the entries of each part."""
    chosen = []
    for entries in codebook:
        at, far = [0], ((entries - entries[0]) ** 2).sum(1)
        while len(at) < min(pivots, len(entries)):
            at.append(int(far.argmax()))
            far = np.minimum(far, ((entries - entries[at[-1]]) ** 2).sum(1))
        chosen.append(entries[at])
    return np.stack(chosen)


def assign(x: np.ndarray, near: np.ndarray, entries: np.ndarray, pivot_entry: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, int]:
    """For one part position: nearest entry, squared distance, and the number
    of exact distances that were evaluated.  ``near`` (n, pivots) are the
    stored pivot distances, ``pivot_entry`` (pivots, entries) the round's."""
    bound = np.zeros((len(x), len(entries)))
    for p in range(near.shape[1]):
        a, b = near[:, p, None].astype(np.float64), pivot_entry[p][None]
        np.maximum(bound, np.abs(a - b) - 4e-7 * (a + b), out=bound)
    order = np.argsort(bound, 1, kind="stable")
    bound = np.take_along_axis(bound, order, 1) ** 2
    best, who = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    active, trials = np.arange(len(x)), 0
    for r in range(len(entries)):
        active = active[bound[active, r] <= best[active]]
        if not len(active):
            break
        c = order[active, r]
        d = ((x[active] - entries[c]) ** 2).sum(1)
        trials += len(active)
        better = (d < best[active]) | ((d == best[active]) & (c < who[active]))
        best[active[better]], who[active[better]] = d[better], c[better]
    return who, best, trials


def _lists(column, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype)


def _with_distances(pivots: np.ndarray):
    def each(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = cut_parts(_lists(batch.column("v"), np.int64))
            near = np.concatenate([distances(x[:, j], pivots[j]) for j in range(PARTS)], 1).astype(np.float32)
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "label", "v", "near"])
    return each


def _assigned(batch, codebook: np.ndarray, pivot_entry: list[np.ndarray]):
    """(x, index, squared distance) of a batch, per part position."""
    x = cut_parts(_lists(batch.column("v"), np.int64))
    near = _lists(batch.column("near"), np.float32).reshape(len(x), PARTS, -1)
    found = [assign(x[:, j], near[:, j], codebook[j], pivot_entry[j]) for j in range(PARTS)]
    return x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), sum(f[2] for f in found)


def _sums(codebook: np.ndarray, pivot_entry: list[np.ndarray]):
    """A task's sums and counts per part position, entry and component."""
    def each(batches):
        total = np.zeros(codebook.shape, np.int64)
        count = np.zeros(codebook.shape[:2], np.int64)
        trials = 0
        for batch in batches:
            if batch.num_rows:
                x, who, _, n = _assigned(batch, codebook, pivot_entry)
                trials += n
                for j in range(PARTS):
                    np.add.at(total[j], who[:, j], x[:, j])
                    count[j] += np.bincount(who[:, j], minlength=codebook.shape[1])
        part, entry = np.nonzero(count)
        for s in range(0, len(part), 1024):
            p, e = part[s:s + 1024], entry[s:s + 1024]
            w = codebook.shape[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(p, w).astype(np.int32)), pa.array(np.repeat(e, w).astype(np.int32)),
                 pa.array(np.tile(np.arange(w, dtype=np.int32), len(p))), pa.array(total[p, e].ravel()),
                 pa.array(np.repeat(count[p, e], w)), pa.array(np.repeat(trials, w * len(p)))],
                names=["part", "entry", "pos", "total", "n", "trials"])
    return each


def _codes(codebook: np.ndarray, pivot_entry: list[np.ndarray]):
    def each(batches):
        for batch in batches:
            if batch.num_rows:
                _, who, square, _ = _assigned(batch, codebook, pivot_entry)
                text = who.astype(np.uint8).tobytes().hex()
                step = 2 * PARTS
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"),
                     pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()), pa.array(square.sum(1))],
                    names=["id", "label", "code", "error"])
    return each


class Codec:
    """Fitted codebooks (PARTS, entries, width) and the pivots of the pruning."""

    def __init__(self, codebook: np.ndarray, pivots: np.ndarray):
        self.codebook, self.pivots = codebook, pivots

    def pivot_entry(self) -> list[np.ndarray]:
        return [distances(self.codebook[j], self.pivots[j]).T for j in range(PARTS)]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebook.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, key: str, vector: str, label: str, rounds: int = ROUNDS, entries: int = ENTRIES,
        pivots: int = PIVOTS) -> tuple[Codec | None, DataFrame]:
    """The codec after ``rounds`` rounds, and the stored table ``id, label, v,
    near`` of the vectors that take part."""
    spark = vectors.sparkSession
    rows = integers(vectors, key, vector, label)
    order = [F.col("id").isNull(), F.col("id"), F.col("v")]
    first = rows.orderBy(*order).select(F.size("v").alias("d")).first()
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    if first is None:
        return None, rows
    rows = rows.where(F.size("v") == first["d"])
    start = np.array([r["v"] for r in rows.orderBy(*order).select("v").limit(entries).collect()], np.int64)
    codebook = cut_parts(start.reshape(len(start), first["d"])).transpose(1, 0, 2).copy()
    codec = Codec(codebook, choose_pivots(codebook, pivots))
    with bounded_batches(spark, 4096):
        table = stored(rows.mapInArrow(freeing(_with_distances(codec.pivots)),
                                       f"id {kind['id']}, label {kind['label']}, v array<int>, near array<float>"), "parts")
        for _ in range(rounds):
            sums = (table.mapInArrow(freeing(_sums(codec.codebook, codec.pivot_entry())),
                                     "part int, entry int, pos int, total long, n long, trials long")
                    .groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
            moved = codec.codebook.copy()
            for r in sums:
                moved[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
            if (moved == codec.codebook).all():
                break  # further rounds would repeat this one
            codec = Codec(moved, codec.pivots)
    return codec, table


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             rounds: int = ROUNDS, entries: int = ENTRIES, pivots: int = PIVOTS) -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256`` per vector that takes
    part; ``label_error`` sums the errors of equal labels, nulls together."""
    spark = vectors.sparkSession
    codec, table = fit(vectors, key, vector, label, rounds, entries, pivots)
    kind = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = f"id {kind['id']}, label {kind['label']}, code string, error long"
    if codec is None:
        coded, digest = spark.createDataFrame([], schema), hashlib.sha256(b"").hexdigest()
    else:
        with bounded_batches(spark, 4096):
            coded = stored(table.mapInArrow(freeing(_codes(codec.codebook, codec.pivot_entry())), schema), "codes")
        digest = codec.digest()
    # written, so that both sides of the join are plain scans and a hot label can be split
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = (sums if codec is None else stored(sums, "label_errors")).toDF("of", "label_error")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
