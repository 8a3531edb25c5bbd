"""Language identification with a string kernel.

The kernel is the blended spectrum of byte n-grams (n = 1 to 3, ASCII letters
lower-cased), by presence: k(x, y) is the number of distinct n-grams that both
texts have, normalised by sqrt(k(x, x) k(y, y)).  The Nyström map over a set
of landmark texts turns it into features, kernel ridge regression (targets +1
and -1) learns one score per language against the rest, and a batch of texts
is scored by one matrix product of their presence rows with the learned
weights of the landmarks' n-grams.

Training takes a documented, bounded sample: about ``MAX_TRAIN`` labelled rows
over all languages, the same number of each (those with the smallest key
hashes), and ``LANDMARKS`` of them as landmarks.  Scoring reads whole texts.

Whether a text is in any of the languages is told by its *familiarity*, which
doesn't depend on their number: the share of its distinct letter trigrams (of
letter pairs or letters, if it has no longer ones) that ``COMMON`` of some
language's landmarks have.  A text is foreign if its familiarity is below half
of the training rows' median (each looked up without itself) by more than one
standard error, so a few junk rows among the labelled ones don't move the cut.

A text that is null or has no letter is ``und`` with score 0; so is every text
if there is no labelled row.  Ties go to the language that is first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, free_memory, freeing, held_out, small_batches

MAX_TRAIN, LANDMARKS, RIDGE = 2400, 160, 1e-2
COMMON = 0.2  # of a language's landmarks, two at least
_SIZES = (0, 256, 256 + 65536, 256 + 65536 + (1 << 24))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEN: list[np.ndarray] = []
_VOCAB: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def grams(text: bytes) -> np.ndarray:
    """The distinct n-grams of a text, as numbers."""
    if not _SEEN:
        _SEEN.append(np.zeros(_SIZES[3], np.int32))
    seen = _SEEN[0]
    b = _LOWER[np.frombuffer(text, np.uint8)].astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    every = np.concatenate([b, two + _SIZES[1], three + _SIZES[2]])
    place = np.arange(len(every), dtype=np.int32)
    seen[every] = place  # the last of equal n-grams stays
    return every[seen[every] == place]


class Model:
    """``names``: languages; ``vocab``: the landmarks' n-grams; ``weights``
    (n-grams x languages) and ``bias`` give the scores; ``common`` marks the
    n-grams that make a text familiar, ``cut`` is the least familiarity."""

    def __init__(self, names: list[str], vocab: np.ndarray, weights: np.ndarray, bias: np.ndarray, common: np.ndarray,
                 cut: float):
        self.names, self.vocab, self.weights, self.bias = names, vocab, weights.astype(np.float32), bias
        self.common, self.cut = np.append(common, False), cut

    def foreign(self, s: np.ndarray) -> bool:
        """A text's n-grams are too few of any language's, beyond one standard error."""
        own = of_letters(s)
        if not len(own):
            return False
        share = self.common[_lookup(self.vocab)[own]].mean()
        return bool(share + np.sqrt(self.cut * (1 - self.cut) / len(own)) < self.cut)

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        lookup = _lookup(self.vocab)
        presence = np.zeros((len(sets), len(self.vocab) + 1), np.float32)
        for i, s in enumerate(sets):
            presence[i, lookup[s]] = 1
        size = np.sqrt(np.maximum([len(s) for s in sets], 1))
        return (presence[:, :-1] @ self.weights) / size[:, None] + self.bias


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True  # ASCII letters and all bytes of other characters


def of_letters(s: np.ndarray) -> np.ndarray:
    """The longest n-grams of a set that are made of letters alone."""
    for size in (2, 1, 0):
        v = s[(s >= _SIZES[size]) & (s < _SIZES[size + 1])]
        b = v - _SIZES[size]
        v = v[np.logical_and.reduce([_LETTER[(b >> (8 * i)) & 255] for i in range(size + 1)])]
        if len(v):
            return v
    return s[:0]


def _common(sets: list[np.ndarray], langs: list[str], chosen: list[int], vocab: np.ndarray) -> tuple[np.ndarray, float]:
    """Which n-grams of the vocabulary are common, and the least familiarity of a text that isn't foreign."""
    if not len(vocab):
        return np.zeros(0, bool), 0.0

    def place(s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(vocab, s), len(vocab) - 1)
        return at[vocab[at] == s]
    spare = {}  # landmarks that have the n-gram, beyond those it needs
    for name in sorted({langs[i] for i in chosen}):
        own = [i for i in chosen if langs[i] == name]
        spare[name] = -np.full(len(vocab), max(2, int(np.ceil(COMMON * len(own)))))
        for i in own:
            spare[name][place(sets[i])] += 1
    common = np.logical_or.reduce([x >= 0 for x in spare.values()])
    landmark, shares = set(chosen), []
    for i, s in enumerate(sets):
        tri = of_letters(s)
        at = place(tri)
        if i in landmark:  # without itself
            hit = np.logical_or.reduce([x[at] >= (name == langs[i]) for name, x in spare.items()])
        else:
            hit = common[at]
        if len(tri):
            shares.append(hit.sum() / len(tri))
    return common, float(np.median(shares)) / 2 if shares else 0.0


def _lookup(vocab: np.ndarray) -> np.ndarray:
    """n-gram number to column, made once per worker; the last column is for all others."""
    mark = vocab.tobytes()
    if _VOCAB.get("of", (b"",))[0] != mark:
        table = np.full(_SIZES[3], len(vocab), np.int32)
        table[vocab] = np.arange(len(vocab))
        _VOCAB["of"] = (mark, table)
    return _VOCAB["of"][1]


def fit(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression on a sample's n-gram sets."""
    names = sorted(set(langs))
    by = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    chosen = [i for n in names for i in by[n][:max(1, landmarks // len(names))]]
    vocab = np.unique(np.concatenate([sets[i] for i in chosen])) if chosen else np.empty(0, np.int32)
    place = lambda s: np.searchsorted(vocab, s[np.isin(s, vocab)])
    z = np.zeros((len(chosen), len(vocab)))
    for row, i in enumerate(chosen):
        z[row, place(sets[i])] = 1
    z /= np.sqrt(np.maximum(z.sum(1, keepdims=True), 1))
    kzz = z @ z.T
    values, vectors = np.linalg.eigh(kzz)
    keep = values > 1e-8 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])           # K_zz^(-1/2)
    x = np.zeros((len(sets), len(chosen)))
    for i, s in enumerate(sets):
        row = np.zeros(len(vocab))
        row[place(s)] = 1
        x[i] = z @ row / np.sqrt(max(len(s), 1))
    features = np.hstack([x @ half, np.ones((len(sets), 1))])
    target = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    penalty = ridge * len(sets) / max(1, features.shape[1]) * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(features.T @ features + penalty, features.T @ target)
    return Model(names, vocab, z.T @ (half @ beta[:-1]), beta[-1], *_common(sets, langs, chosen, vocab))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS) -> Model | None:
    """A model of the labelled rows that are not held out; None if there are none."""
    small_batches(docs.sparkSession, 256)
    rows = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(key).alias("k"), F.col(text).cast("binary").alias("t"), F.col(lang).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(4, max_train // len(counts))
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, min(1.0, each / n))])

    def sets(batches):
        for batch in batches:
            got = [grams(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("place"), pa.array([g.tobytes() for g in got], pa.binary())],
                names=["lang", "place", "grams"])
        _SEEN.clear()

    sample = rows.withColumn("place", place).where(F.col("place") < F.element_at(share, F.col("lang")))
    # ordered, so that the bound takes the same rows in every run
    got = sample.orderBy("place", F.xxhash64("t", "lang"), "t").limit(4 * max(max_train, 4 * len(counts))).mapInArrow(freeing(sets), "lang string, place double, grams binary").collect()
    got.sort(key=lambda r: (r["place"], r["lang"], bytes(r["grams"])))
    if not got:  # so few rows that the hashes chose none
        return None
    return fit([np.sort(np.frombuffer(r["grams"], np.int32)) for r in got], [r["lang"] for r in got], landmarks)


def annotate(docs: DataFrame, model: Model | None, text: str = "text", name: str = "lang_pred",
             score: str = "lang_score", foreign: str | None = None) -> DataFrame:
    """``docs`` with the columns ``name`` and ``score`` (0 to 1) added, in place of
    any that are called so, and ``foreign`` (boolean) if that is given.  Only the
    text is looked at."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    if model is None:
        return docs.withColumns({name: F.lit("und"), score: F.lit(0.0)} | ({foreign: F.lit(False)} if foreign else {}))
    shared = spark.sparkContext.broadcast(model)  # n-grams of LANDMARKS texts: bounded

    def scored(m: Model, texts: list[bytes | None]) -> pa.Array:
        known = [i for i, t in enumerate(texts) if t is not None]
        names, scores, strange = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        for at in range(0, len(known), 256):
            block = known[at:at + 256]
            sets = [grams(texts[i]) for i in block]
            s = m.scores(sets)
            for i, j, top in zip(block, s.argmax(1), s.max(1)):
                names[i], scores[i] = m.names[j], float(min(1.0, max(0.0, (top + 1) / 2)))
            if foreign:
                for i, own in zip(block, sets):
                    strange[i] = m.foreign(own)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                           pa.array(strange, pa.bool_())], ["name", "score", "foreign"])

    @F.arrow_udf("struct<name: string, score: double, foreign: boolean>")
    def each(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in columns:
                yield scored(shared.value, column.to_pylist())
        finally:  # a reused worker doesn't keep the tables
            _SEEN.clear()
            _VOCAB.clear()
            free_memory()

    held = free_name(docs, "found")
    found = docs.withColumn(held, each(F.when(F.col(text).rlike(r"\p{L}"), F.col(text).cast("binary"))))
    more = {foreign: F.col(f"{held}.foreign")} if foreign else {}
    return found.withColumns({name: F.col(f"{held}.name"), score: F.col(f"{held}.score")} | more).drop(held)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, lang_pred, score`` (0 to 1), one row per row of ``docs``."""
    rows = docs.select(F.col(key).alias("k"), held_out(key).alias("held_out"), F.col(text).alias("t"))
    return annotate(rows, model, "t", "lang_pred", "score").select(F.col("k").alias(key), "held_out", "lang_pred", "score")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Trains on the labelled rows and predicts all rows."""
    return predict(docs, train(docs, key, text, lang), key, text)
