"""Upper limits for the assigner's objectives on the tables of scale 0.01."""

import os

import pytest
from pyspark.sql import functions as F

from checks import registry
from rotaloom.operators import score

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(
    not os.environ.get("ROTALOOM_LONG") or not os.path.isdir(SF), reason="takes minutes; set ROTALOOM_LONG=1"
)


@pytest.mark.parametrize(
    "rules, limits", [(registry.TEAM, {"A": 700_000, "KVW": 1_245_000}), (registry.PLAYER, {"A": 740_000, "KVW": 2_675_000})]
)
def test_objective_stays_below(spark, rules, limits):
    season = registry._season(spark, SF, rules)
    run = season.assign()
    assert run.uncovered().isEmpty()
    scored = score.score(run.roster, run.workers, season.free, season.costs, rules)
    total = {r.problem: float(r.total) for r in scored.groupBy("problem").agg(F.sum("objective").alias("total")).collect()}
    assert {p: total[p] <= most for p, most in limits.items()} == {p: True for p in limits}, total
