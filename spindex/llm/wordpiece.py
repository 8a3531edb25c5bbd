"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  Each node has a failure link to the node where
matching goes on after the longest pieces that are certain by now have been
popped, and the *number* of those pieces; so the greedy longest-match
(word-piece) length of a word comes from one walk over its characters, and no
piece is ever built.  A word that cannot be cut into pieces counts as one
unknown token.

A text's words are runs of anything but ASCII white space, each led by
``lead`` (the vocabulary's word start).  Null and empty texts have no words.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, small_batches

REMEMBER = 500_000


class Automaton:
    """Trie over ``pieces``: ``next[node]`` maps a character to a node,
    ``fail[node]`` is the failure link (-1: none) and ``popped[node]`` the
    number of pieces popped on taking it."""

    def __init__(self, pieces: Iterable[str], lead: str = ""):
        self.lead = lead
        self.next: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = self.next[node][c]
            whole[node] = node != 0
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0])
        while queue:  # by depth: links lead to shallower nodes
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if whole[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], n
        self.counts: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        """Pieces of ``word`` (as given); 0 if it can't be cut into pieces."""
        nexts, fail, popped = self.next, self.fail, self.popped
        node = n = 0
        for c in word:
            while c not in nexts[node]:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = nexts[node][c]
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return n

    def text(self, text: bytes) -> tuple[int, int, int]:
        """Words, tokens and words that are unknown."""
        words = text.split()  # bytes: at ASCII white space only
        new = set(words).difference(self.counts)
        if len(self.counts) + len(new) > REMEMBER:
            self.counts, new = {}, set(words)
        for w in new:
            self.counts[w] = self.count(self.lead + w.decode())
        found = list(map(self.counts.__getitem__, words))
        unknown = found.count(0)
        return len(words), sum(found) + unknown, unknown


_MODELS: dict[str, Automaton] = {}


def from_sentencepiece(path: str) -> Automaton:
    """The automaton over a sentencepiece file's ordinary pieces."""
    if path not in _MODELS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _MODELS[path] = Automaton(
            [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))], "▁")
    return _MODELS[path]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_tokens, n_unknown``, one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def each(batches):
        automaton = from_sentencepiece(path)
        for batch in batches:
            cols = list(zip(*map(automaton.text, batch.column("t").to_pylist()))) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("k")] + [pa.array(c, pa.int64()) for c in cols],
                                             names=["k", "n_words", "n_tokens", "n_unknown"])

    return (docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
            .mapInArrow(freeing(each), f"k {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("k", key))
