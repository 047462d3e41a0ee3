"""Exact dedup against a plain grouping, also where digests clash."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rotaloom.llm import exact_dedup as E

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "a "), (6, "A"), (None, "a"), (None, "solo"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "b"), (9, "b")]


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        members = groups[text or ""]
        keep = max((m for m in members if m is not None), default=None)
        out.append((doc_id, keep, len(members), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("clashing", [False, True])
def test_groups(spark, clashing):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as _salt", "2 as keep_id").repartition(5)
    got = E.exact_groups(docs, digest=F.length("_text") % 2 if clashing else None)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)


def test_hot_text(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    found = E.exact_groups(docs.repartition(16)).filter("group_size > 1")
    assert [tuple(r) for r in found.select("keep_id", "group_size").distinct().collect()] == [(4998, 1667)]


def test_keep_one_passes_all_columns(spark):
    rows = [(1, "a", "x", 1), (2, "a", None, 2), (2, "a", "y", 3), (3, None, "z", 4), (4, "", "z", 5), (None, "a", "n", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string, _rest int")
    got = E.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(2, "a", "y", 3), (4, "", "z", 5)], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert E.exact_groups(docs).count() == 0 and E.keep_one(docs).count() == 0
