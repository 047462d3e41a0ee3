"""Registered queries against their SQL statements on the smallest tables."""

import os

import pytest

from checks import compare, oracle, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")

STATEMENTS = oracle.sql()
LONG_RUNNING = {"assigner_summary", "assigner_player_mode", "fixed_roster_status", "season_totals", "assigner_hot_org"}


def test_every_query_is_registered_once():
    assert set(STATEMENTS) <= set(registry.queries())


@pytest.mark.parametrize("name", [n for n in STATEMENTS if n not in LONG_RUNNING])
def test_rows_match(spark, name):
    names, rows = compare.spark_rows(registry.queries()[name](spark, SF))
    want_names, want = compare.duck_rows(compare.connect(SF), STATEMENTS[name])
    assert names == want_names
    assert rows == want
