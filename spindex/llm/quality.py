"""Quality classification with a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Every
byte becomes a learned vector; learned filters slide over a chunk and their
rectified outputs are max-pooled per filter; with the chunk's length they go
through a small hidden layer to the chunk's logit, and the byte-weighted mean
of the chunk logits is the document's, whose sigmoid is the score.

Training (backpropagation and Adam, balanced classes) takes a documented
sample bounded in rows: about ``MAX_TRAIN`` labelled documents, half of either
label, each with its whole text, and a random short piece of each, so that
short texts are known too.  Both training and scoring read every byte, a
bounded number of chunks (``BLOCK``) at a time.

Null text counts as empty: a chunk of padding.  With labels of one kind only,
or none, every score is that label, or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, held_out, small_batches

CHUNK, STEP = 512, 448
WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 8, 4, 8, 32, 16
MAX_TRAIN, EPOCHS, BLOCK = 1600, 14, 128
THRESHOLD = 0.7
PAD = 256


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of a text (rows of symbols 0 to 256) and the bytes each adds."""
    n = len(text)
    count = max(1, -(-max(0, n - (CHUNK - STEP)) // STEP))
    padded = np.full((count - 1) * STEP + CHUNK, PAD, np.int16)
    padded[:n] = np.frombuffer(text, np.uint8)
    out = np.lib.stride_tricks.as_strided(padded, (count, CHUNK), (padded.strides[0] * STEP, padded.strides[0]))
    weight = np.full(count, float(STEP))
    weight[-1] = max(1, n - STEP * (count - 1))
    return out, weight


class Net:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.emb = np.vstack([rng.normal(0, 0.5, (256, DIM)), np.zeros((1, DIM))]).astype(np.float32)
        self.w = rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.u = rng.normal(0, FILTERS ** -0.5, (FILTERS + 1, HIDDEN)).astype(np.float32)
        self.a = np.zeros(HIDDEN, np.float32)
        self.v = rng.normal(0, HIDDEN ** -0.5, HIDDEN).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.w, self.b, self.u, self.a, self.v, self.c]

    def _top(self, best: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled features with the chunk's length, hidden units and logits."""
        length = np.log2((x != PAD).sum(1, keepdims=True) + 1.0).astype(np.float32) / 9
        f = np.hstack([np.maximum(best + self.b, 0), length])
        g = np.maximum(f @ self.u + self.a, 0)
        return f, g, g @ self.v + self.c

    def _windows(self, x: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * DIM) view of the embedded chunks."""
        e = self.emb[x]
        places = (CHUNK - WIDTH) // STRIDE + 1
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(x), places, WIDTH * DIM), (s[0], s[1] * STRIDE, s[2]))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filter outputs per chunk, and where each was reached."""
        z = self._windows(x).reshape(-1, WIDTH * DIM) @ self.w
        z = z.reshape(len(x), -1, FILTERS)
        return z.max(1), z

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._top(self.pooled(x[i:i + BLOCK])[0], x[i:i + BLOCK])[2] for i in range(0, len(x), BLOCK)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        parts = [chunks(t) for t in texts]
        owner = np.repeat(np.arange(len(parts)), [len(w) for _, w in parts])
        weight = np.concatenate([w for _, w in parts])
        logit = np.concatenate([self.logits(group) for group in _grouped([p for p, _ in parts])])
        mean = np.bincount(owner, logit * weight, len(parts)) / np.bincount(owner, weight, len(parts))
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))

    def gradients(self, x: np.ndarray, owner: np.ndarray, weight: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over the documents ``y``."""
        best, at = [], []                                            # chunks x filters
        for i in range(0, len(x), BLOCK):
            some, z = self.pooled(x[i:i + BLOCK])
            best.append(some)
            at.append(z.argmax(1))
        best, at = np.concatenate(best), np.concatenate(at)
        f, g, logit = self._top(best, x)
        share = weight / np.bincount(owner, weight, len(y))[owner]
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, logit * share, len(y)), -30, 30)))
        d = ((p - y) / len(y))[owner] * share                        # by chunk logit
        dg = (d[:, None] * self.v) * (g > 0)
        dh = (dg @ self.u[:FILTERS].T) * (f[:, :FILTERS] > 0)        # chunks x filters
        dw, demb = np.zeros_like(self.w), np.zeros_like(self.emb)
        for i in range(0, len(x), BLOCK):
            part, dpart = x[i:i + BLOCK], dh[i:i + BLOCK]
            starts = at[i:i + BLOCK] * STRIDE
            symbols = part[np.arange(len(part))[:, None, None], starts[:, :, None] + np.arange(WIDTH)]  # chunks x filters x width
            dw += np.einsum("cf,cfwd->wdf", dpart, self.emb[symbols], optimize=True).reshape(WIDTH * DIM, FILTERS)
            de = dpart[:, :, None, None] * self.w.T.reshape(FILTERS, WIDTH, DIM)[None]
            np.add.at(demb, symbols.ravel(), de.reshape(-1, DIM))
        demb[PAD] = 0
        return [demb, dw, dh.sum(0), f.T @ dg, dg.sum(0), (d[:, None] * g).sum(0), np.array([d.sum()])]

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 32,
            rate: float = 0.01, seed: int = 5) -> "Net":
        rng = np.random.default_rng(seed)
        moment = [(np.zeros_like(p, np.float64), np.zeros_like(p, np.float64)) for p in self.params()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for s in range(0, len(order), batch):
                pick = order[s:s + batch]
                some = [chunks(texts[i]) for i in pick]
                some += [piece(x, rng) for x, _ in some]
                x = np.concatenate([d[0] for d in some])
                owner = np.repeat(np.arange(len(some)), [len(d[1]) for d in some])
                weight = np.concatenate([d[1] for d in some])
                step += 1
                lr = rate * (1 - epoch / epochs)
                for p, (m, v), g in zip(self.params(), moment, self.gradients(x, owner, weight, np.tile(y[pick], 2))):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (lr * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def piece(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A random short piece of one of a document's chunks, as a document."""
    row = x[rng.integers(len(x))]
    row = row[row != PAD]
    n = min(len(row), int(2 ** rng.uniform(3, 8.5)))
    at = int(rng.integers(0, len(row) - n + 1))
    out = np.full((1, CHUNK), PAD, np.int16)
    out[0, :n] = row[at:at + n]
    return out, np.array([float(max(1, n))])


def _grouped(parts: list[np.ndarray], rows: int = 256):
    """Chunks of several texts together, a bounded number at a time."""
    held: list[np.ndarray] = []
    n = 0
    for p in parts:
        for i in range(0, len(p), rows):
            held.append(p[i:i + rows])
            n += len(held[-1])
            if n >= rows:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          max_train: int = MAX_TRAIN) -> Net | float:
    """A network of the labelled rows that are not held out; the constant score if there is nothing to learn."""
    small_batches(docs.sparkSession, 256)
    known = labels.where(~held_out(key) & F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    share = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, min(1.0, max_train / 2 / n))])
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.withColumn("place", place).where(F.col("place") < F.element_at(share, F.col("y")))
    # ordered, so that the bounds take the same rows in every run
    chosen = chosen.orderBy("place", "k", "y").limit(4 * max_train)

    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    # at most 4 * MAX_TRAIN small rows are broadcast
    got = texts.join(F.broadcast(chosen), "k").select(F.col("y").cast("int").alias("y"), "place", "t").orderBy(
        "place", F.xxhash64("t", "y"), "t").limit(8 * max_train).collect()
    got.sort(key=lambda r: (r["place"], r["y"], bytes(r["t"])))
    y = np.array([r["y"] for r in got], float)
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    return Net().fit([bytes(r["t"]) for r in got], y)


def score(docs: DataFrame, net: Net | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted``, one row per row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), held_out(key).alias("held_out"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    if isinstance(net, float):
        out = rows.select("k", "held_out", F.lit(net).alias("score"))
    else:
        shared = spark.sparkContext.broadcast(net)

        def each(batches):
            for batch in batches:
                texts = batch.column("t").to_pylist()
                s = shared.value.score(texts) if texts else []
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("held_out"), pa.array(s, pa.float64())],
                                                 names=["k", "held_out", "score"])

        out = rows.mapInArrow(freeing(each), f"k {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumnRenamed("k", key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Trains on the labelled rows and scores all rows."""
    return score(docs, train(docs, labels, key, text, label), key, text)
