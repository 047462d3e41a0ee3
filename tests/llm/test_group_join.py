"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from rotaloom.llm import group_join as G
from rotaloom.llm.components import components


def brute(rows, gram, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        words = (text or "").translate(lower).encode().split()
        if len(words) >= gram:
            sets.append(frozenset(tuple(words[i : i + gram]) for i in range(len(words) - gram + 1)))
        else:
            sets.append(frozenset([tuple(words)] if words else []))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[root(i)] = root(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = best.setdefault(root(i), [])
        if doc_id is not None:
            ids.append(doc_id)
    return sorted(
        ((d, len(sets[i]), (min(best[root(i)], default=None) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str
    )


def family(rng, n, words):
    """Copies of a text with a few words changed, so that some pairs are linked and some are not."""
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(text)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(words)] = f"c{rng.randrange(50)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("gram, percent", [(3, 90), (5, 80)])
def test_groups(spark, gram, percent):
    rng = random.Random(percent)
    line = "this one line is very common and stands in most of the texts"
    texts = [t for _ in range(6) for t in family(rng, 12, rng.randrange(30, 140))]
    texts += [f"{line} {' '.join(f'u{rng.randrange(10**5)}' for _ in range(rng.randrange(3, 30)))}" for _ in range(40)]
    texts += [None, "", " \n", "one", "One", "one two", "a b c", "A b C", texts[0], texts[0].upper().replace("W", "w"), "x " * 500]
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, "alone with nobody here"), (7, texts[7]), (900, "word " + " ".join(map(str, range(5000))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as digest").repartition(4)
    got = G.jaccard_groups(docs, gram, percent).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, gram, percent)


def test_groups_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "GROUP", 4)
    monkeypatch.setattr(G, "TABLE_ROWS", 16)
    rng = random.Random(4)
    rows = list(enumerate(t for _ in range(4) for t in family(rng, 14, 60)))
    got = G.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 3, 70)


def test_only_groups_that_may_hold_a_partner_are_opened():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 9, (6, G.CELLS))
    comp = np.repeat(np.arange(6), 10)
    cells = (base[comp] + rng.integers(0, 2, (60, G.CELLS))).astype("<u4")
    zeros = np.zeros(60, np.int64)
    t = {"gram": zeros, "q": zeros, "g": zeros, "block": zeros, "node": np.arange(60), "n": cells.sum(axis=1).astype(np.int64), "comp": comp, "cells": cells}
    for percent, most in ((50, 300), (70, 250), (80, 0)):
        a, b, asked, opened = G.open_groups(t, percent)
        want = {
            (i, j) for i in range(60) for j in range(i + 1, 60)
            if comp[i] != comp[j] and G.linked(np.minimum(cells[i], cells[j]).sum(), t["n"][i], t["n"][j], percent)
        }
        assert set(zip(a.tolist(), b.tolist())) == want and asked == 60 * 5 and opened <= most


def test_cell_counts_of_any_size():
    counts = np.array([[0] * G.CELLS, [255] * G.CELLS, [256] + [0] * (G.CELLS - 1), [70_000] * G.CELLS])
    stored = [G.stored_cells(c) for c in counts]
    assert [len(s) for s in stored] == [64, 64, 256, 256] and (G.cells_of(stored) == counts).all()


def test_chain_through_a_third_text(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(words)), (2, " ".join(words[1:] + ["x1"])), (1, " ".join(words[2:] + ["x1", "x2"])), (0, " ".join(words[3:] + ["x1", "x2", "x3"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in G.jaccard_groups(docs, 3, 90).collect())
    assert got == brute(rows, 3, 90) and {g[2] for g in got} == {0}


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(5, base, 1), (2, base + " end", 2), (9, base, 3), (3, "other text", 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash int")
    got = G.keep_one(docs, 3, 90)
    assert got.columns == docs.columns and sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
    assert G.keep_one(docs.limit(0)).count() == 0 and G.jaccard_groups(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 3), (7, 6), (6, 5), (5, 4), (4, 3), (20, 20)] + [(100, 100 + i) for i in range(1, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(1, 8)} == {1} and got[11] == 10 and got[20] == 20 and {got[100 + i] for i in range(50)} == {100}


def test_first_meetings_lose_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lists = [sorted(rng.choice(30, rng.integers(1, 12), replace=False).tolist()) for _ in range(8)]
        rows = [(g, i) for i, held in enumerate(lists) for g in held]
        gram = np.array([g for g, _ in rows])
        lowest = G.lowest_of([lists[i][: G.LOWEST] for _, i in rows])
        pairs = [(x, y) for x in range(len(rows)) for y in range(len(rows)) if rows[x][0] == rows[y][0] and rows[x][1] < rows[y][1]]
        left, right = (np.array(side, np.int64) for side in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
        seen = [(rows[x][1], rows[y][1]) for (x, y), new in zip(pairs, G.first_meetings(gram, lowest, left, right)) if new]
        assert set(seen) == {(rows[x][1], rows[y][1]) for x, y in pairs}
        for a, b in set(seen):
            if set(lists[a][: G.LOWEST]) & set(lists[b][: G.LOWEST]):
                assert seen.count((a, b)) == 1


def test_texts_are_compared_in_small_batches(spark, monkeypatch):
    """Rows with two whole texts come in batches of BATCH_ROWS; the session's setting is as before afterwards."""
    setting, seen, keep = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, G.Scratch.keep
    before = spark.conf.get(setting)

    def noted(self, df, label, slot=None):
        seen[label] = spark.conf.get(setting)
        return keep(self, df, label, slot)

    monkeypatch.setattr(G.Scratch, "keep", noted)
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + " x"), (3, "other words only here")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in G.jaccard_groups(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert seen["sets"] == seen["found"] == str(G.BATCH_ROWS) and spark.conf.get(setting) == before


def test_marks_lose_no_link():
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 5, 40, 700, 3000, 12000):
        whole = np.unique(rng.integers(0, 2**64, 2 * n, np.uint64))
        sets.append(np.sort(whole[:n]))
        for other in (n // 50, n // 9, n // 4, n):
            sets.append(np.sort(np.concatenate([whole[other // 2 : n], whole[n : n + other // 2]])))
    left, right = np.array([(i, j) for i in range(len(sets)) for j in range(i)]).T
    n = np.array([len(s) for s in sets])
    common = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(left, right)])
    unlike = n[left] + n[right] - 2 * common
    marks = [G.marks_of(s) for s in sets]
    assert (G.least_unlike(marks, left, right) <= unlike).all()
    for percent in (80, 90):
        true = G.linked(common, n[left], n[right], percent)
        assert true.any() and G.may_link(marks, left, right, n[left], n[right], percent)[true].all()


def test_long_texts_with_a_common_passage_are_no_pairs(spark, monkeypatch):
    # Cell counts alone left room for a link between any two of these texts, and each pair was a row.
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(3000))} {passage}" for _ in range(12)]
    rows = {}
    keep = G.Scratch.keep

    def counted(self, df, label, slot=None):
        kept = keep(self, df, label, slot)
        if label in ("more", "close"):
            rows[label] = rows.get(label, 0) + kept.count()
        return kept

    monkeypatch.setattr(G.Scratch, "keep", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = G.jaccard_groups(docs, 5, 80).collect()
    assert all(r.component_id == r.doc_id for r in told) and len(told) == len(texts)
    assert rows == {"more": 0, "close": 0}


def test_marks_take_two_bits_a_gram_at_most():
    # They travel with every posting of a set; four to eight bits a gram were most of what the join shuffled.
    rng = np.random.default_rng(6)
    for n in (0, 1, 128, 129, 490, 1024, 1025, 20000):
        size = len(G.marks_of(np.unique(rng.integers(0, 2**64, n, np.uint64))))
        assert G.LEAST_MARKS <= size <= max(G.LEAST_MARKS, n / 4) and (n > 8 * G.MOST_MARKS or 8 * size >= n)
