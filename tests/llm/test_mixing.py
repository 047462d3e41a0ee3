"""Source mixing against a plain version."""

import math
from collections import defaultdict

import pytest

from rotaloom.llm import mixing as M

ROWS = [(i, "w " * (i % 37), f"s{i % 3}") for i in range(400)] + [(500 + i, "x y", None) for i in range(5)]
ROWS += [(600, None, "empty"), (601, "", "empty"), (None, "a b c", "s1"), (700, "dup dup", "s0"), (700, "dup dup", "s0"), (701, "long " * 3000, "tiny")]


def brute_targets(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return sizes, target | share
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return sizes, target


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'n' as n_docs", "1 as _key")


def test_targets_and_taken(spark):
    sizes, target = brute_targets(ROWS)
    planned = M.plan(docs_of(spark, ROWS).repartition(5)).collect()
    assert len(planned) == len(ROWS)
    taken = defaultdict(int)
    for r in planned:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], abs=1e-6) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for source, goal in target.items():
        longest = max(r.size for r in planned if r.source == source)
        assert abs(taken[source] - goal) <= longest / 2 + 1e-6
    again = M.plan(docs_of(spark, ROWS).repartition(2)).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.copies, r.position or -1)
    assert sorted(map(key, planned)) == sorted(map(key, again))


def test_ranges_do_not_change_the_queue(spark, monkeypatch):
    before = {r.doc_id: r.position for r in M.plan(docs_of(spark, ROWS[:400])).collect()}
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 7)
    assert before == {r.doc_id: r.position for r in M.plan(docs_of(spark, ROWS[:400])).collect()}


def test_positions_follow_the_schedule(spark):
    """By training time t a source has had its share (1 - s)t + st^2 of its words."""
    planned = M.plan(docs_of(spark, ROWS[:400])).collect()
    for nr, source in enumerate(["s0", "s1", "s2"]):
        rows = [r for r in planned if r.source == source]
        slope, target = M.SLOPES[nr % 3], rows[0].target
        for t in (0.25, 0.5, 0.9):
            had = sum(r.size for r in rows for p in r.positions if p < t)
            assert math.isclose(had, target * ((1 - slope) * t + slope * t * t), abs_tol=80)


def test_stream(spark):
    docs = docs_of(spark, ROWS)
    stream = M.mix(docs).collect()
    assert [r.position for r in stream] == sorted(r.position for r in stream)
    assert len(stream) == sum(r.copies for r in M.plan(docs).collect())


def test_shares_come_from_the_sorted_stream(spark, monkeypatch):
    """Per document what the written stream holds; the stream is in order of position over its files."""
    docs, written = docs_of(spark, ROWS).select("doc_id", "text", "source"), {}
    keep = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, label: written.setdefault(label, keep(df, label)))
    got = M.shares(docs)
    columns = ["doc_id", "size", "source_size", "target", "taken", "position"]
    want = M.plan(docs).select(*columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    stream, files = written["stream"], sorted(written["stream"].inputFiles())
    positions = [r.position for f in files for r in spark.read.parquet(f).select("position").collect()]
    assert positions == sorted(positions) and len(positions) == stream.count() > 0


def test_empty(spark):
    assert M.plan(docs_of(spark, ROWS).limit(0)).count() == 0
    alone = M.plan(docs_of(spark, [(1, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in alone] == [(0, 0.0, 0)]
