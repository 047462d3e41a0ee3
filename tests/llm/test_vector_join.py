"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pyarrow as pa

from rotaloom.llm import vector_join as V


def brute(rows, cosine=0.95):
    """rows of (id, list or None) to sorted (id, n_links, component_id, kept)."""
    def sound(x):
        return x is not None and len(x) and all(c is not None and math.isfinite(c) for c in x) and any(x)

    dim = max((len(x) for _, x in rows if sound(x)), default=0)
    full = [np.array(list(x) + [0.0] * (dim - len(x))) if sound(x) else None for _, x in rows]
    full = [x if x is None else x / np.abs(x).max() for x in full]
    full = [x if x is None else x / np.linalg.norm(x) for x in full]
    group, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(full):
        for j in range(i):
            if x is not None and full[j] is not None and float(x @ full[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        least = min((k for k in ids[root(i)] if k is not None), default=None)
        out.append((key, links[i], least, key is not None and key == least))
    return sorted(out, key=str)


def near(rng, base, cosine):
    step = rng.normal(size=len(base))
    step -= step @ base * base
    return cosine * base + math.sqrt(1 - cosine**2) * step / np.linalg.norm(step)


def crowd(rng, n, dim):
    """Vectors of a few themes with planted partners on both sides of the limit, chains and a dense group."""
    themes = rng.normal(size=(5, dim))
    base = themes[rng.integers(5, size=n)] + rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    out = [b * rng.uniform(0.1, 9) for b in base]
    for i in range(0, n, 4):
        out.append(near(rng, base[i], rng.choice([0.93, 0.951, 0.97, 0.999])))
        out.append(near(rng, out[-1] / np.linalg.norm(out[-1]), 0.96))
    out += [near(rng, base[0], 0.985) for _ in range(n // 4)]
    return [x.tolist() for x in out]


def got(df, **options):
    return sorted((tuple(r) for r in V.near_vectors(df, **options).collect()), key=str)


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    rng = np.random.default_rng(5)
    vectors = crowd(rng, 400, 48)
    rows = [(int(k), x) for k, x in zip(rng.permutation(len(vectors)), vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as vector").repartition(3)
    want = brute(rows)
    assert got(df) == want and got(df, sure=None) == want
    assert sum(r[1] for r in want) > 5000


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (None, [1.0, 0.1, 0.0]),
        (4, None), (5, []), (6, [0.0, -0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 1.0, 0.0]), (9, [None, 1.0, 0.0]),
        (None, None), (10, [0.0, 1.0]), (11, [0.0, 5.0, 0.0]), (12, [1e300, 0.0, 1e300]), (13, [1e-300, 0.0, 1e-300]), (14, [-1.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == [] and got(df.filter("embedding is null")) == [(4, 0, 4, True), (None, 0, None, False)]


def test_codes_and_tables():
    rng = np.random.default_rng(1)
    x = V.unit(rng.normal(size=(900, 20)))
    model = V.fit(x, 900)
    own, codes, error = model.code(x)
    stands = np.concatenate([book[codes[:, p]] for p, book in enumerate(model.books)], axis=1) + model.centres[own]
    assert np.allclose(np.linalg.norm(x - stands, axis=1), error)
    place = int(own[0])
    listed = own == place
    table = model.distances(x[:50], place, codes[listed])
    assert np.allclose(table, np.linalg.norm(x[:50, None] - stands[listed], axis=2), atol=1e-3)
    # A query probes its own list, and with the whole reach every list that holds a partner.
    reach = math.sqrt(2 - 2 * 0.5)
    probes = model.probes(x, own, reach)
    i, j = np.nonzero(x @ x.T >= 0.5)
    assert probes[i, own[j]].all()


def test_forest():
    a, b = np.array([1, 2, 7, 9]), np.array([2, 3, 8, 9])
    assert V.forest(a, b, 10).tolist() == [0, 1, 1, 1, 4, 5, 6, 7, 7, 9]
    assert V.matrix(pa.array([[1.0], [2.0, 3.0]]), 2).tolist() == [[1, 0], [2, 3]]
