"""Plans of steps whose tables all grow with the games."""

from pyspark.sql import functions as F

from checks import registry
from rotaloom.operators import candidates, disjoin, feasible, model, report, score
from rotaloom.operators.assign import one_pass_roster
from rotaloom.plans.season import Season
from rotaloom.plans.skew import salted_join
from rotaloom.rules import Rules

TEAM = Rules()


def small_season(make_games, make_persons):
    games = make_games((1, "2018-09-15", "14:00", True, "mD1"), (1, "2018-09-16", "15:00", True, "M1"))
    return Season(games, make_persons((1, 1, "M1", 0, None), (1, 2, "F1", 0, None), (1, 3, "Aufsicht", 0, None)), TEAM)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layout_collects_no_days_on_the_driver(make_games, make_persons):
    season = small_season(make_games, make_persons)
    full = season.full(season.simple_roster)
    layout = report.roster_layout(full, season.shifts, season.games, season.people, TEAM)
    assert "BroadcastExchange" not in plan_of(layout) and layout.count() > 0


def test_candidates_are_dealt_out_once_for_the_weekend_rule(make_games, make_persons):
    season = small_season(make_games, make_persons)
    made = plan_of(candidates.candidates(season.shifts, season.workers, season.windows, TEAM))
    assert "LeftAnti" not in made
    flagged = plan_of(candidates.weekend_flags(season.candidates, season.kickoffs))
    # The candidates by day and the kick-offs by day; the rule per shift needs nothing further.
    assert flagged.count("Exchange hashpartitioning") == 2


def test_shift_facts_and_plain_roster_sort_no_candidates(make_games, make_persons):
    season = small_season(make_games, make_persons)
    facts = candidates.shift_facts(season.free)
    assert "SortAggregate" not in plan_of(facts) + plan_of(candidates.slot_facts(season.free)) and facts.count() == season.free.select("org_id", "shift_id").distinct().count()
    roster = one_pass_roster(season.free, season.workers, TEAM)
    # The heads of the classes are a struct; the candidates are not combined by one.
    assert plan_of(roster).count("SortAggregate") == 2


def test_expanding_repeats_members_and_not_candidates(make_games, make_persons):
    season = small_season(make_games, make_persons)
    lines = candidates.expand(season.free, season.workers, TEAM)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line and "n_slots" not in line.split("explode", 1)[1].split("]")[0])
    repeated = "\n".join(lines[at + 1 :])
    assert "worked_min" in repeated and "shift_id" not in repeated


def test_fixed_rows_deal_candidates_out_once(make_games, make_persons):
    season = small_season(make_games, make_persons)
    fixed = season.workers.select(
        "org_id", F.lit("2018-09-15").cast("date").alias("shift_date"), F.lit(840).alias("start_min"), F.lit(990).alias("end_min"),
        F.lit("Kasse").alias("duty_type"), "team_code", "name", F.lit(0).alias("slot_nr"),
    )
    good, _ = candidates.merge_fixed(fixed, season.candidates, season.workers, TEAM)
    assert "distinct" not in plan_of(good).lower()


def test_repeated_rows_of_a_salted_join_are_not_collected(spark):
    big = spark.range(1000).selectExpr("id % 7 as k", "id as v")
    small = spark.range(7).selectExpr("id as k", "id * 10 as w")
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = salted_join(big, small, ["k"], how, ["v"], 16)
        assert "BroadcastExchange" not in plan_of(joined) and joined.count() == (0 if how == "left_anti" else 1000)


def test_members_and_their_loads_are_not_collected(make_games, make_persons):
    season = small_season(make_games, make_persons)
    full, rules = season.full(season.simple_roster), season.rules
    people = (full, season.shifts, season.people)
    # Means of organisations are not joined by persons; the rest must be merged.
    for df in (report.team_stats(*people, rules), score.balance(season.simple_roster, season.active, season.free, rules),
               score.proximity(season.simple_roster, season.active, season.free, season.costs, rules),
               score.violations(season.simple_roster, season.active, season.free, rules, season.simple_roster, season.candidates),
               report.person_stats(*people, season.targets, rules), report.idle_stats(*people, season.workers, rules)):
        assert "BroadcastExchange" not in plan_of(df) and df.count() >= 0


def test_rules_of_single_members_collect_nothing(make_games, make_persons):
    season = small_season(make_games, make_persons)
    roster = season.simple_roster
    found = score.violations(roster, season.active, season.free, season.rules.with_(team_mode=False))
    assert "BroadcastExchange" not in plan_of(found) and "BroadcastExchange" not in plan_of(registry._named_slots(season))


def test_model_collects_no_pairs_rows_or_loads(make_games, make_persons):
    season = small_season(make_games, make_persons)
    for mode in (season.rules, season.rules.with_(team_mode=False)):
        built = model.build_model(season.pairs, season.active, mode)
        solution = model.solution_of(season.simple_roster, built, season.pairs, season.active)
        for df in (built.rows, built.coefs, solution, model.objective(built, solution), model.broken_rows(built, solution), model.broken_sets(built, solution)):
            assert "BroadcastExchange" not in plan_of(df)


def test_pieces_and_moments_collect_nothing(make_games, make_persons):
    season = small_season(make_games, make_persons)
    keys = ["org_id", "problem", "team_code", "shift_date"]
    spans = season.candidates.select(*keys, "start_min", "end_min").distinct()
    for df in (disjoin.disjoin(spans, keys), feasible.impossible_moments(season.free)):
        assert "BroadcastExchange" not in plan_of(df)
    fixed = season.workers.select(
        "org_id", F.lit("2018-09-15").cast("date").alias("shift_date"), F.lit(840).alias("start_min"), F.lit(990).alias("end_min"),
        F.lit("Kasse").alias("duty_type"), "team_code", "name", F.lit(0).alias("slot_nr"),
    )
    assert all("BroadcastExchange" not in plan_of(df) for df in candidates.merge_fixed(fixed, season.candidates, season.workers, TEAM))
