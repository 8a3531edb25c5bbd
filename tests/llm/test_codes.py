"""Vector codes: exact assignment under pruning, whole runs against a plain loop, odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindex.llm import codes


def plain(rows, rounds=6, entries=16):
    """id -> (code, error), codebook digest, by exhaustive integer distances."""
    kept = [(i, [int(np.floor(np.float64(x) * 4096)) for x in v]) for i, v, _ in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    kept = [(i, np.array(v + [0] * (-d % 8), np.int64).reshape(8, -1)) for i, v in kept if len(v) == d]
    x = np.stack([v for _, v in kept])
    book = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        square = np.stack([((x[:, j, None] - book[j][None]) ** 2).sum(2) for j in range(8)], 1)
        return square.argmin(2), square.min(2)

    for _ in range(rounds):
        who, _ = nearest()
        for j in range(8):
            for e in range(book.shape[1]):
                own = x[who[:, j] == e, j]
                if len(own):
                    book[j, e] = [int(t) // len(own) for t in own.sum(0)]
    who, square = nearest()
    out = [(i, "".join(f"{c:02x}" for c in w), int(s.sum())) for (i, _), w, s in zip(kept, who, square)]
    return out, hashlib.sha256(",".join(str(int(c)) for c in book.ravel()).encode()).hexdigest()


@pytest.mark.parametrize("spread", [3, 50, 1 << 27])
def test_assignment_is_exact_and_prunes(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (16, 6))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-1, 2, (3000, 6))
    book = centres.copy()
    book[5], book[9] = book[2], book[0]  # ties
    pivots = codes.choose_pivots(book[None], 4)[0]
    near = codes.distances(x, pivots).astype(np.float32)
    who, best, trials = codes.assign(x, near, book, codes.distances(book, pivots).T)
    square = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (best == square.min(1)).all() and (who == square.argmin(1)).all()
    assert trials < x.shape[0] * len(book) * (0.9 if spread > 3 else 1.01)


SCHEMA = "vec_id long, embedding array<float>, label int"


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("id", "v", "near", "code", "error", "of"):
        df = df.withColumn(name, F.lit("extra"))
    return codes.compress(df).collect()


def check(spark, rows):
    got = found(spark, rows)
    want, digest = plain([(i, v, l) for i, v, l in rows])
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=str) == sorted(want, key=str)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    label = {}
    for i, v, l in rows:
        label.setdefault(i, set()).add(l)
    total = {}
    for i, _, e in want:
        (l,) = label[i]
        total[l] = total.get(l, 0) + e
    for r in got:
        (l,) = label[r["vec_id"]]
        assert r["label_error"] == total[l]


def test_whole_run_equals_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(rng.standard_normal(32))], [None, 1, 2][i % 3]) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(200)]  # copies
    check(spark, rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    v = lambda n: [float(x) for x in np.float32(rng.standard_normal(n))]
    rows = [(i, v(12), 1) for i in range(5)]  # fewer than 16, and no multiple of 8
    rows += [(10, None, 1), (11, [float("nan")] * 12, 1), (12, [None] * 12, None), (13, [float("inf")] * 12, 2), (14, v(8), 3),
             (15, [], 3), (16, [0.0] * 12, None), (16, [0.0] * 12, None), (None, v(12), None)]
    check(spark, rows)
    got = found(spark, [(1, [1e30, -1e30], 1), (2, [0.0, 0.0], 1)])
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == [(1, "0000" + "00" * 6, 0), (2, "0101" + "00" * 6, 0)]


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == []
