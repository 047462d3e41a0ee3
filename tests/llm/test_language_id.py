"""Language identification: exact kernel values, held-out accuracy, odd rows."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rotaloom.llm import language_id as L

SF = "/root/testdata/sf0.001"


def grams(text):
    codes = "".join(c if not c.isascii() or c.isalpha() else " " for c in text.lower())
    return {codes[i : i + n] for n in (1, 2, 3) for i in range(len(codes) - n + 1)}


def test_kernel_is_shared_grams(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on a mat", "en"), ("le chat est là-bas", "fr")] * 30)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    slots = model.table()
    texts = ["the mat", "là où le chat", "x1 y2!"]
    present = model.presence(texts, slots)
    known = {L.gram_codes(L.code_points(g))[len(g) - 1][0]: g for t, _ in [(r[1], 0) for r in rows] for g in grams(t)}
    names = [known[c] for c in model.grams]
    for row, text in zip(present, texts):
        assert {n for n, p in zip(names, row) if p} == grams(text) & set(names)
    k = model.kernel(present)
    sizes = present.sum(axis=1)[:, None] * model.landmarks.sum(axis=0)
    assert np.allclose(k, present @ model.landmarks / np.sqrt(np.maximum(sizes, 1)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.predict(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    again = {(r.doc_id, r.lang_pred, r.score) for r in L.predict(docs.repartition(5)).collect()}
    assert {(r.doc_id, r.lang_pred) for r in rows} == {(a, b) for a, b, _ in again}


def test_odd_rows(spark):
    rows = [(1, "the house and the garden", "en"), (2, "das haus und der garten", "de")] * 20
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    rows += [(90, None, "en"), (91, "", None), (92, "12 !? 34", "de"), (93, "the " * 100_000, None), (None, "und das", "xx"), (93, "the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as lang_pred")
    got = L.predict(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (90, 91, 92)} == {"und"}
    assert {r.lang_pred for r in got} == {"en", "de", "und"}  # a row without id is not learnt from


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.predict(docs).collect()] == [("und", 0.0)]
    assert L.predict(docs.limit(0)).count() == 0


def test_long_batches_are_scored_row_by_row(spark, monkeypatch):
    """More texts than are scored at a time, some without a letter: every row has its own language, none is read whole."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on a mat", "en"), ("le chat est là-bas", "fr")] * 30)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    at_once, presence = [], L.Model.presence
    monkeypatch.setattr(L.Model, "presence", lambda self, texts, slots: at_once.append(len(texts)) or presence(self, texts, slots))
    monkeypatch.setattr(L, "map_arrow", lambda df, function, schema: function)
    score = L.identify(spark.createDataFrame(rows[:1], "doc_id long, text string, lang string").select("text"), "text", model)
    texts = [("the cat on the mat", "le chat là", "12 3", None)[i % 4] for i in range(4 * L.TEXTS + 3)] + ["1"] * L.TEXTS * 2
    (out,) = score(iter([pa.record_batch([pa.array(texts)], names=["text"])]))
    told = {"the cat on the mat": "en", "le chat là": "fr"}
    assert out.column("lang_pred").to_pylist() == [told.get(t, L.UNDECIDED) for t in texts]
    assert sum(at_once) == sum(t in told for t in texts) and max(at_once) <= L.TEXTS // 2
