"""Substring dedup and its index against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rotaloom.llm import substring_dedup as S
from rotaloom.llm.fm_index import FMIndex, WaveletTree


def brute(rows, window=35):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for doc_id, words in texts:
        covered = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                covered[i : i + window] = [True] * window
        kept = b" ".join(w for w, c in zip(words, covered) if not c)
        out.append((doc_id, len(words), sum(covered), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_wavelet_tree_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 37, 500)
    tree = WaveletTree(text, 37)
    at = rng.integers(0, 501, 300)
    symbols = rng.integers(0, 37, 300)
    assert tree.rank(symbols, at).tolist() == [int((text[:a] == s).sum()) for s, a in zip(symbols, at)]


@pytest.mark.parametrize("size", [2, 5])
def test_matching_statistics(size):
    rng = np.random.default_rng(size)
    text = rng.integers(0, size, 200)
    index = FMIndex(np.append(text + 1, 0), size + 1, 9)
    ends = np.arange(200)
    most = np.minimum(ends + 1, 9)

    def longest(end, limit):
        for n in range(limit, 0, -1):
            piece = text[end - n + 1 : end + 1].tolist()
            if sum(text[i : i + n].tolist() == piece for i in range(201 - n)) >= 2:
                return n
        return 0

    assert index.repeated_lengths(text + 1, ends, most).tolist() == [longest(e, m) for e, m in zip(ends, most)]


@pytest.mark.parametrize("frequent", [2000, 2])
def test_documents(spark, monkeypatch, frequent):
    monkeypatch.setattr(S, "FREQUENT_ANCHOR", frequent)
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(40)) for _ in range(n))
    passage, tail = words(60), words(34)
    rows = [(i, f"{words(rng.randrange(50))} {passage if i % 3 else words(20)} {words(9)}") for i in range(25)]
    rows += [(100 + i, f"{words(10)}\n{tail}") for i in range(3)]
    rows += [(200, None), (201, ""), (202, "x " * 90), (203, "a b " * 60), (None, passage), (None, "solo"), (300, words(80))]
    rows += [(204, " ".join(map(str, range(200)))), (205, " ".join(map(str, range(100, 260)))), (300, rows[-1][1])]
    rows += [(301, words(5000)), (302, f"é{words(40)} \x0b {passage[:200]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as hits", "'t' as text_hash").repartition(4)
    assert sorted((tuple(r) for r in S.dedup(docs).collect()), key=str) == brute(rows)


def test_nothing_to_remove(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert [r.n_removed for r in S.dedup(docs, with_text=True).collect()] == [0, 0]
    assert S.dedup(docs.limit(0)).count() == 0
