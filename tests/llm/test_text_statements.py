"""Queries with an SQL statement against it, all others for one row per input row."""

import os

import pytest

from checks import compare
from rotaloom.llm import registry, statements

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")


@pytest.mark.parametrize("name", statements.sql())
def test_rows_match(spark, name):
    names, rows = compare.spark_rows(registry.queries()[name](spark, SF))
    want_names, want = compare.duck_rows(compare.connect(SF), statements.sql()[name])
    assert names == want_names and rows == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(statements.sql()) - {"pipeline"}))
def test_one_row_each(spark, name):
    table, key = ("pages", "page_id") if "main_text" in name else ("documents", "doc_id")
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in registry.queries()[name](spark, SF).select(key).collect()) == want
