"""Vector codes against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from rotaloom.llm import vector_codes as V


def brute(rows, entries=256):
    """rows of (id, label, vector) to sorted (id, code, error, label_error, sha)."""
    rows = [r for r in rows if r[2] is not None and all(c is not None and math.isfinite(c) for c in r[2])]
    dim = max((len(x) for _, _, x in rows), default=0)
    from fractions import Fraction

    full = [[math.floor(Fraction(c) * 1024) for c in list(x) + [0.0] * (dim - len(x))] for _, _, x in rows]
    cut = [0]
    for p in range(4):
        cut.append(cut[-1] + dim // 4 + (p < dim % 4))
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:entries]
    books = [[full[i][cut[p] : cut[p + 1]] for i in first] for p in range(4)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x[cut[p] : cut[p + 1]], e)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        books_now = []
        for p in range(4):
            held = {}
            for x in full:
                held.setdefault(nearest(p, x)[1], []).append(x[cut[p] : cut[p + 1]])
            books_now.append([[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])])
        books = books_now
    coded = [[nearest(p, x) for p in range(4)] for x in full]
    error = [sum(d for d, _ in c) for c in coded]
    by_label = {}
    for (_, label, _), e in zip(rows, error):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    most = (1 << 63) - 1
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in c), min(e, most), min(by_label[label], most), sha) for (i, label, _), c, e in zip(rows, coded, error)),
        key=str,
    )


def got(df):
    return sorted((tuple(r) for r in V.compress(df).collect()), key=str)


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("dim, n", [(8, 400), (6, 300), (3, 40), (16, 1)])
def test_rows(spark, dim, n, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    rng = np.random.default_rng(dim)
    rows = [(int(i), int(i) % 3 if i % 7 else None, (rng.integers(-6, 6, dim) / 8).tolist()) for i in rng.permutation(n)]
    rows += rows[: n // 9]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as code", "1 as codes").repartition(3)
    assert got(df) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, 1, [0.5, -0.25, 1.0, 3.0]), (2, 1, None), (3, None, [nan, 1.0, 1.0, 1.0]), (4, 2, [inf, 0.0, 0.0, 0.0]), (1, 2, [0.1, None, 0.0, 0.0]),
        (None, None, [0.5, 0.5]), (None, 3, [0.0, 0.0, 0.0, -0.0001]), (5, 4, [0.5, -0.25, 1.0, 2.0]), (9, None, []),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == [] and got(df.filter("vec_id = 2")) == [] and len(got(df.filter("vec_id = 9"))) == 1


def test_numbers_beyond_64_bits(spark):
    rows = [(i, 0, [x, -x, 1.5, 0.0]) for i, x in enumerate([1e9, 3e15, 1e30, 1e30, 2.5, -1e300])]
    rows += [(100 + i, 1, [float(i)] * 4) for i in range(300)]
    assert got(spark.createDataFrame(rows[:4] + rows[6:], SCHEMA)) == brute(rows[:4] + rows[6:])
    assert V.integers(np.array([[1e300]])).tolist() == [[int(1e300) * 1024]]
