"""Word shingles of whole texts as sorted 64-bit hashes, in numpy.

A text is lower-cased in A-Z and cut into runs of anything but ASCII white
space.  A document's set holds the hashes of its distinct n-word shingles; a
text of fewer words has one member, its whole word sequence; a text without
words has none.  Two different shingles share a hash with probability 2^-64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U)          # a random value for each byte
_BYTE[65:91] = _BYTE[97:123]                              # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x5851F42D4C957F2D                                # odd: it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=U) * U(2) + U(1)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 2 * len(_POWERS[0]))
        for i, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n, base, U)
            row[0] = 1
            _POWERS[i] = np.cumprod(row, dtype=U)
    return _POWERS


def forget() -> None:
    """Frees the powers, so that a reused worker doesn't keep them."""
    _POWERS[:] = [np.ones(1, U), np.ones(1, U)]


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word; the hash of a word is a polynomial in its
    bytes, got as a difference of prefix sums."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum(_BYTE[b] * power[:len(b)], out=total[1:])
    return start, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))


def sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The shingle set of each text, sorted; about a megabyte of text at a time."""
    return [s for a, b in blocks(texts, 1 << 20) for s in _sets(texts[a:b], n)]


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    start, h = words(b" ".join(texts) + b" ")
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
    if len(h) >= n:
        sums = np.zeros(len(h) - n + 1, U)
        for j in range(n):
            sums += h[j:len(h) - n + 1 + j] * _PLACE[j]
        sums = mix(sums)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            s = np.sort(sums[a:b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:  # the whole sequence, told apart from any n-word shingle
            out.append(mix((h[a:b] * _PLACE[:b - a]).sum(dtype=U, keepdims=True) + U((b - a) * int(_PLACE[63]) & (1 << 64) - 1)))
        else:
            out.append(np.empty(0, U))
    return out


def blocks(texts: list[bytes], size: int = 4 << 20):
    """Index ranges of texts of about ``size`` bytes together (one at least)."""
    a = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield a, i
            a, held = i, 0
        held += len(t)
    if a < len(texts):
        yield a, len(texts)
