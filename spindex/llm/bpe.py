"""BPE encoding and decoding by tree concatenation.

A text of more than ``leaf * STRETCH`` bytes is cut in halves, wherever the
middle falls, down to stretches of that size.  Each stretch is encoded by
itself, and neighbours are joined by re-encoding a window of pieces around
the join that grows until its outermost pieces have the encodings that stood
there before on both sides.  (Pieces are what ASCII white space delimits; the
tokenizer drops it, and no rule of it looks across.)  Texts of ``deal_out``
characters or more have their stretches dealt out as rows, so that many tasks
encode them, and joined per document.

A piece is encoded once per worker and then looked up.  A *long* piece (no
white space to cut at) is not handed to the tokenizer whole either: its words
are cut in halves down to leaves, the leaves are encoded, and neighbours are
joined by a window of tokens that grows until its first and last token are the
ones that stood there before.  Then every adjacent pair of tokens of the joined
sequence occurs in a valid encoding, and a sequence all of whose adjacent pairs
are compatible is the encoding of its text; so the join is exact.  Documents
that hold a piece of ``deal_out`` characters have such leaves dealt out.

Null text counts as empty and gives no tokens and an empty decoded text.
Repeated rows and null keys are encoded like any other row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, freeing_group, small_batches

#: Symbols of an unsplit word that are encoded at once.
LEAF = 64
#: Leaves that a stretch of text, encoded by itself, is long.
STRETCH = 64
#: Text, in characters, from which a document's stretches are dealt out.
DEAL_OUT = 1 << 16
#: Pieces a worker remembers.
REMEMBER = 80_000

#: Pieces of printable ASCII and Latin letters (U+00C0 to U+017F but the signs
#: and U+0130): normal forms already, lower-cased letter by letter, and cut
#: into words by the tokenizer's pattern as it reads for these characters.
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u017f]+")
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]

_ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Stretch(NamedTuple):
    """A stretch of text: its pieces, what each is encoded as (packed ids and
    decoded text), and whether it begins and ends inside a piece."""

    pieces: list[bytes]
    found: list[tuple[bytes, str]]
    opens: bool
    closes: bool


class TreeBPE:
    """One tokenizer file in one worker."""

    def __init__(self, path: str, leaf: int = LEAF):
        import json

        from tokenizers import Tokenizer

        self.leaf, self.path = leaf, path
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.model = self.full.model
        self._inner = None
        spec = json.load(open(path, encoding="utf-8"))
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")"
                                 ) if self.added else None
        n = self.full.get_vocab_size(with_added_tokens=True)
        self.names = [self.full.id_to_token(i) or "" for i in range(n)]
        self.known: dict[bytes, tuple[bytes, str]] = {}      # piece: packed ids, decoded text
        self.known_words: dict[str, tuple[bytes, str]] = {}
        self.joins = self.grown = 0                          # joins of stretches, windows beyond the first
        # the short way holds for files with these rules; others always go through the library
        rules = (spec.get("normalizer") or {}).get("normalizers", []), (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = ([r["type"] for r in rules[0]] == _NORMAL and [r["type"] for r in rules[1]] == ["Split", "ByteLevel"]
                      and rules[1][0]["pattern"].get("Regex") == _PATTERN and rules[1][0]["invert"])
        from tokenizers.pre_tokenizers import ByteLevel
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)} if self.plain else {}

    @property
    def inner(self):
        """The same merges without the word-end suffix, made when a long run asks for it."""
        if self._inner is None:
            import json

            from tokenizers import models

            m = json.load(open(self.path, encoding="utf-8"))["model"]
            self._inner = models.BPE(m["vocab"], [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]])
        return self._inner

    # ---- one unsplit word, as the symbols the model merges

    def _encode(self, symbols: str, at_end: bool) -> list[int]:
        return [t.id for t in (self.model if at_end else self.inner).tokenize(symbols)]

    def _symbols(self, ids: list[int]) -> str:
        text = "".join(self.names[i] for i in ids)
        return text.removesuffix(self.suffix) if self.suffix else text

    def join(self, left: list[int], right: list[int], at_end: bool) -> list[int]:
        """The encoding of two neighbours' concatenation from their encodings."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            whole_left, whole_right = k >= len(left), k >= len(right)
            window = self._encode(self._symbols(a) + self._symbols(b), at_end and whole_right)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[:len(left) - len(a)] + window + right[len(b):]
            k *= 2

    def word(self, symbols: str, at_end: bool = True) -> list[int]:
        if len(symbols) <= self.leaf:
            return self._encode(symbols, at_end)
        mid = len(symbols) // 2
        return self.join(self.word(symbols[:mid], False), self.word(symbols[mid:], at_end), at_end)

    # ---- runs without ASCII white space

    def words(self, run: str) -> Iterator[tuple[int | None, str]]:
        """(id, "") of an added token or (None, symbols) of a word, in order."""
        for part in self._added.split(run) if self._added else [run]:
            if part in self.added:
                yield self.added[part], ""
            elif part:
                text = self.full.normalizer.normalize_str(part) if self.full.normalizer else part
                for symbols, _ in self.full.pre_tokenizer.pre_tokenize_str(text):
                    yield None, symbols

    def run(self, run: str) -> list[int]:
        out: list[int] = []
        for known, symbols in self.words(run):
            out += [known] if known is not None else self.word(symbols)
        return out

    # ---- whole texts

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return np.asarray(ids, "<u4").tobytes(), " ".join([self.names[i] for i in ids])

    def _word(self, word: str) -> tuple[bytes, str]:
        tokens = self.model.tokenize(word if word.isascii() else word.translate(self.bytes_of))
        found = np.asarray([t.id for t in tokens], "<u4").tobytes(), " ".join([t.value for t in tokens])
        if len(self.known_words) >= REMEMBER:
            self.known_words.clear()
        self.known_words[word] = found
        return found

    def learn(self, pieces: list[bytes]) -> None:
        words, rest = self.known_words, []
        for p in pieces:
            text = p.decode()
            if self.plain and len(p) <= self.leaf and _PLAIN.fullmatch(text) and "<|" not in text:
                got = [words.get(w) or self._word(w) for w in _WORDS.findall(text.lower())]
                self.known[p] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))
            else:
                rest.append(p)
        short = [p for p in rest if len(p) <= self.leaf]
        found = [e.ids for e in self.full.encode_batch([p.decode() for p in short], add_special_tokens=False)]
        long = [p for p in rest if len(p) > self.leaf]
        for piece, ids in zip(short + long, found + [self.run(p.decode()) for p in long]):
            self.known[piece] = self._packed(ids)

    def lookup(self, pieces: list[bytes]) -> list[tuple[bytes, str]]:
        if len(self.known) > REMEMBER:
            self.known = {}
        new = set(pieces).difference(self.known)
        if new:
            self.learn(list(new))
        return list(map(self.known.__getitem__, pieces))

    def stretch(self, text: bytes) -> Stretch:
        """A text by itself: halves down to stretches, joined again."""
        if len(text) <= self.leaf * STRETCH:
            pieces = text.split()  # bytes: at ASCII white space only
            return Stretch(pieces, self.lookup(pieces), not text[:1].isspace(), not text[-1:].isspace())
        mid = len(text) // 2
        while text[mid] & 0xC0 == 0x80:  # not inside a character
            mid += 1
        return self.join_texts(self.stretch(text[:mid]), self.stretch(text[mid:]))

    def join_texts(self, a: Stretch, b: Stretch) -> Stretch:
        """The encoding of two neighbours' concatenation from their encodings."""
        if not a.pieces or not b.pieces:  # one is white space alone
            return Stretch(a.pieces + b.pieces, a.found + b.found, a.opens and bool(a.pieces), b.closes and bool(b.pieces))
        self.joins += 1
        if not (a.closes and b.opens):  # the cut fell at white space: nothing to re-encode
            return Stretch(a.pieces + b.pieces, a.found + b.found, a.opens, b.closes)
        k = 1
        while True:
            left, right = a.pieces[-k:], b.pieces[:k]
            window = [*left[:-1], left[-1] + right[0], *right[1:]]
            found = self.lookup(window)
            if (k >= len(a.pieces) or found[0][0] == a.found[-k][0]) and (k >= len(b.pieces) or found[-1][0] == b.found[k - 1][0]):
                return Stretch(a.pieces[:-k] + window + b.pieces[k:], a.found[:-k] + found + b.found[k:], a.opens, b.closes)
            k += 1
            self.grown += 1

    def encode(self, text: bytes) -> tuple[bytes, str]:
        """Packed little-endian ids and the decoded text."""
        got = self.stretch(text).found
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])

    def decode(self, ids: bytes) -> str:
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_MODELS: dict[tuple[str, int], TreeBPE] = {}


def model(path: str, leaf: int = LEAF) -> TreeBPE:
    if (path, leaf) not in _MODELS:
        _MODELS[path, leaf] = TreeBPE(path, leaf)
    return _MODELS[path, leaf]


_OUT = "ids binary, decoded string"


def _key_type(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
           leaf: int = LEAF, deal_out: int = DEAL_OUT) -> DataFrame:
    """``key``, ``ids`` (binary: little-endian unsigned 32-bit token ids) and
    ``decoded`` (the text those ids decode to), one row per row of ``docs``."""
    small_batches(docs.sparkSession, 256)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    long = F.length("t") >= deal_out
    kind = _key_type(docs, key)

    def each(batches):
        bpe = model(path, leaf)
        for batch in batches:
            got = [bpe.encode(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array([g[0] for g in got], pa.binary()),
                 pa.array([g[1] for g in got], pa.string())], names=["k", "ids", "decoded"])
        _MODELS.clear()  # a reused worker doesn't keep it; loading takes a fraction of a second

    short = rows.where(~long).select("k", F.col("t").cast("binary").alias("t")).mapInArrow(freeing(each), f"k {kind}, {_OUT}")
    return short.unionByName(_dealt_out(rows.where(long), kind, path, leaf, deal_out)).withColumnRenamed("k", key)


def _dealt_out(rows: DataFrame, kind: str, path: str, leaf: int, deal_out: int) -> DataFrame:
    """Long documents: one row per stretch, or per stretch of a word if a piece is
    long itself, encoded wherever the row lands, then joined per document (its
    ids fit where its text did)."""
    step = leaf * STRETCH  # characters, or symbols, of a dealt row
    edge = 2               # pieces of a dealt stretch that a window may reach

    def cut(bpe, t):
        """(word, at, last, known, symbols) of a document: word -1 marks stretches of the text."""
        pieces = _ASCII_SPACE.split(t)
        if max(map(len, pieces)) < deal_out:
            for at in range(0, len(t), step):
                yield -1, at, at + step >= len(t), -1, t[at:at + step]
            return
        no = 0
        for piece in pieces:
            for known, symbols in bpe.words(piece):
                no += 1
                if known is not None:
                    yield no, 0, True, known, ""
                for at in range(0, len(symbols), step):
                    yield no, at, at + step >= len(symbols), -1, symbols[at:at + step]

    def leaves(batches):
        bpe = model(path, leaf)
        for batch in batches:
            for row, k, t in zip(*(batch.column(c).to_pylist() for c in ("row", "k", "t"))):
                out = [(row, k, 0, 0, True, -1, "")]  # a text without tokens still has a row
                out += [(row, k, *c) for c in cut(bpe, t)]
                for at in range(0, len(out), 10_000):
                    cols = list(zip(*out[at:at + 10_000]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, ty) for c, ty in zip(cols, (
                            pa.int64(), batch.column("k").type, pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()))],
                        names=["row", "k", "word", "at", "last", "known", "symbols"])

    def encoded(batches):
        """Of a word's stretch the ids; of a text's the pieces next to its cuts,
        and between them what no window reaches (a null piece)."""
        bpe = model(path, leaf)
        for batch in batches:
            pieces, ids, opens, closes = [], [], [], []
            for word, s, last, known in zip(*(batch.column(c).to_pylist() for c in ("word", "symbols", "last", "known"))):
                if word >= 0:
                    ids.append([np.asarray([known] if known >= 0 else bpe.word(s, last) if s else [], "<u4").tobytes()])
                    pieces.append([None])
                    opens.append(False)
                    closes.append(False)
                    continue
                got = bpe.stretch(s.encode())
                coded, n = [g[0] for g in got.found], len(got.pieces)
                if n <= 2 * edge:
                    pieces.append(got.pieces)
                    ids.append(coded)
                else:
                    pieces.append([*got.pieces[:edge], None, *got.pieces[-edge:]])
                    ids.append([*coded[:edge], b"".join(coded[edge:-edge]), *coded[-edge:]])
                opens.append(got.opens)
                closes.append(got.closes)
            out = batch.drop_columns(["symbols", "known"])
            for name, values, ty in (("opens", opens, pa.bool_()), ("closes", closes, pa.bool_()),
                                     ("pieces", pieces, pa.list_(pa.binary())), ("ids", ids, pa.list_(pa.binary()))):
                out = out.append_column(name, pa.array(values, ty))
            yield out

    def tree(parts, join):
        while len(parts) > 1:  # neighbours, then neighbours of those
            parts = [join(a, b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
        return parts[0]

    def joined(group: pa.Table) -> pa.Table:
        bpe = model(path, leaf)
        out: list[bytes] = []
        dealt = sorted(zip(*(group.column(c).to_pylist() for c in ("word", "at", "last", "ids", "pieces", "opens", "closes"))),
                       key=lambda r: r[:2])
        for word, parts in groupby(dealt, key=lambda r: r[0]):
            if word < 0:
                whole = tree([Stretch(p, [(i, "") for i in ids], o, c) for _, _, _, ids, p, o, c in parts], bpe.join_texts)
                out += [ids for ids, _ in whole.found]
            else:
                ids, _ = tree([(np.frombuffer(r[3][0], "<u4").tolist(), r[2]) for r in parts],
                              lambda a, b: (bpe.join(a[0], b[0], b[1]), b[1]))
                out.append(np.asarray(ids, "<u4").tobytes())
        ids = b"".join(out)
        return pa.table({"k": group.column("k").slice(0, 1), "ids": pa.array([ids], pa.binary()),
                         "decoded": pa.array([bpe.decode(ids)], pa.string())})

    dealt = (rows.withColumn("row", F.monotonically_increasing_id()).select("row", "k", "t")
             .mapInArrow(freeing(leaves), f"row long, k {kind}, word long, at long, last boolean, known long, symbols string")
             .repartition("row", "word", "at")
             .mapInArrow(freeing(encoded), f"row long, k {kind}, word long, at long, last boolean, opens boolean, "
                                           "closes boolean, pieces array<binary>, ids array<binary>"))
    return dealt.groupBy("row").applyInArrow(freeing_group(joined), f"k {kind}, {_OUT}")


def decode(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded``: the text of packed ids (null ids: empty)."""
    small_batches(coded.sparkSession)
    kind = _key_type(coded, key)

    def each(batches):
        bpe = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array([bpe.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())],
                names=["k", "decoded"])

    return (coded.select(F.col(key).alias("k"), F.col(ids).alias("ids"))
            .mapInArrow(freeing(each), f"k {kind}, decoded string").withColumnRenamed("k", key))


def digests(coded: DataFrame, key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """Counts and hashes of :func:`encode`'s rows, and the columns ``more``."""
    return coded.select(
        key, *more, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
