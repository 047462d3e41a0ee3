"""The pipeline's stages, each on what its predecessor kept."""

import os

import public_tokenizers
import pytest

import corpus_pipeline
from rotaloom.llm import pieces

SF = "/root/testdata/sf0.001"


def test_order_of_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "pieces"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    raw, known, unique, apart, mixed, coded = seen
    assert known.exceptAll(raw).count() == 0
    # Exact dedup: the largest doc_id of each text.
    best = {}
    for r in known.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(best.values())
    # Near copies: one of each group, by all pairs.
    rows = sorted((r.doc_id, r.text) for r in unique.collect())
    from test_group_join import brute

    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})
    # The mix repeats or leaves out whole documents.
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in apart.collect()}
    back = pieces.decode(coded, str(public_tokenizers.path(corpus_pipeline.PIECE_MODEL)))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in mixed.collect())


def test_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (None, "the house is big", "en", "s", 3), (3, "the house is big", "en", "s", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as size", "2 as _rest")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows)


def test_without_languages_texts_with_letters_stay(spark):
    rows = [(1, "the house", None, "s", 9), (2, "12 34", None, "s", 5), (3, None, None, "s", 0), (4, "\u0436", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]
