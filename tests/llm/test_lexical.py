"""Ranked search against scores of all documents."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from rotaloom.llm import common as C
from rotaloom.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, limit=20):
    held = [(d, words(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, w in held:
            s = 0
            for t in words(text):
                if tf := w.count(t):
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * len(w) * n_docs) // total
                    s += weight * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:limit])]
    return sorted(out, key=str)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(200)]
    rates = [1 / (i + 1) for i in range(200)]
    return [(i, " ".join(rng.choices(vocabulary, rates, k=rng.randrange(1, 80)))) for i in range(n)]


def got(docs, items, limit=20):
    return sorted((tuple(r) for r in L.rank(docs, items, limit).collect()), key=str)


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr(L, "QUERY_BLOCK", 7)
    rng = random.Random(3)
    rows = corpus(rng, 600)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:50])] + [(None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1])]
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(220)], k=rng.randrange(1, 30)))) for i in range(25)]
    items += [items[0], (3, "W1, w1! w150"), (None, "w9 w9 w8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'q' as query").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as rank")
    assert got(docs, asked) == brute(rows, items)
    assert got(docs, asked, 3) == brute(rows, items, 3)


def test_awkward_texts(spark):
    rows = [(1, None), (2, ""), (3, "Ärger, ÄRGER straße"), (4, "ÀB ab AB"), (5, "...\n\t"), (6, "mot\x7fmot été"), (7, "été " * 20000), (8, "日本 語")]
    items = [(1, "Ärger ab"), (2, None), (3, ""), (4, "été mot"), (5, "nothing like it"), (6, "日本"), (7, "ÀB ärger")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert got(docs, asked) == brute(rows, items)
    assert got(docs.limit(0), asked) == [] and got(docs, asked.limit(0)) == []
    assert got(docs.filter("doc_id in (1, 2, 5)"), asked) == []
    assert L.rank(docs, asked).schema.simpleString() == "struct<item_id:int,rank:int,doc_id:bigint,score:bigint>"


def test_joint_bounds_hold_and_tighten():
    rng = random.Random(8)
    tighter = 0
    for _ in range(40):
        docs = {t: np.array(sorted(rng.sample(range(30), rng.randrange(1, 20)))) for t in range(6)}
        gains = {t: np.array([rng.randrange(1, 100) for _ in d]) for t, d in docs.items()}
        repeats = {t: rng.randrange(1, 3) for t in docs}
        top = {t: repeats[t] * int(g.max()) for t, g in gains.items()}
        matched = [(0, 1, 0), (2, 3, 1), (4, 5, 2)]
        joint = {p: L.joint([docs[a], docs[b]], [gains[a], gains[b]])[1] for a, b, p in matched}
        order = sorted(docs, key=lambda t: top[t])
        bounds = L.partial_bounds(order, top, matched, joint, repeats)
        plain = np.cumsum([0] + [top[t] for t in order])
        for k in range(len(order) + 1):
            real = np.zeros(30, int)
            for t in order[:k]:
                real[docs[t]] += repeats[t] * gains[t]
            assert real.max() <= bounds[k] <= plain[k]
        assert bounds == sorted(bounds)
        tighter += bounds[-1] < plain[-1]
    assert tighter > 30


def test_weights_of_very_large_indexes():
    tf, length = np.array([3], np.int32), np.array([10**6])
    n_docs, n_terms = 10**10, 7 * 10**13 + 11
    want = 5 * ((10**9 * 3) // (3000 + 12 * (75 + 25 * 10**6 * n_docs // n_terms)))
    assert L.impacts(tf, length, np.array([5]), n_docs, n_terms).tolist() == [want]


def test_shards_go_one_by_one(spark, monkeypatch):
    rows = [(i, f"w{i} " + "abc " * 600_000) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    asked, seen = L.map_arrow, spark.sparkContext.accumulator(0)

    def spy(df, function, schema):
        def one_by_one(batches):
            def checked():
                for batch in batches:
                    assert batch.num_rows == 1
                    seen.add(1)
                    yield batch

            return function(checked())

        return asked(df, one_by_one if "bounds" in df.columns else function, schema)

    monkeypatch.setattr(L, "map_arrow", spy)
    items = spark.createDataFrame([(1, "w2 w3")], "item_id long, text string")
    before = {s: spark.conf.get(s) for s in (C.BATCH_SETTING, C.READER_SETTING)}
    assert [r.doc_id for r in L.rank(docs, items).orderBy("rank").collect()] == [2, 3]
    # Counted, prepared and searched.
    assert seen.value == 3 * 4 and before == {s: spark.conf.get(s) for s in before}


def test_a_shard_goes_on_with_the_next_batch():
    rng = random.Random(5)
    rows = corpus(rng, 300) + [(None, None), (7, "")]
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    whole = list(L.shard_rows(iter(table.to_batches())))
    empty = pa.RecordBatch.from_pylist([], table.schema)
    parts = list(L.shard_rows(iter([empty, *table.to_batches(17), empty])))
    assert len(whole) == 1 and [p.to_pylist() for p in parts] == [p.to_pylist() for p in whole]
