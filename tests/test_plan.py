"""Model, scorer, assigner, reports, skew helpers and plan shape."""

import itertools
import os
from functools import reduce

import pytest
from conftest import tuples
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_candidates import PLAYER, TEAM, random_season

from rotaloom.operators import assign as A
from rotaloom.operators import candidates as C
from rotaloom.operators import disjoin, model, report, score
from rotaloom.operators import shifts as S
from rotaloom.plans.season import Season
from rotaloom.plans.skew import salted_join, spread_row_number


@pytest.fixture
def player_season(make_games, make_persons):
    season = Season(*random_season(make_games, make_persons, 11), PLAYER)
    return season, C.expand(season.free, season.workers, PLAYER)


def make_cands(spark, shifts, n_slots, n_persons, team="M1"):
    """Hand-made candidates: every shift open to one class of persons."""
    import datetime as dt

    rows = [
        (1, f"s{i}", dt.date(2000, 1, 8), s, e, "Kasse", "KVW", n_slots, n_slots, e - s, team, False, "", n_persons, 90)
        for i, (s, e) in enumerate(shifts)
    ]
    return spark.createDataFrame(
        rows,
        "org_id int, shift_id string, shift_date date, start_min int, end_min int, duty_type string, problem string, "
        "n_people int, n_slots int, minutes int, team_code string, is_supervisor boolean, coach_of string, "
        "n_persons long, cost long",
    )


def make_workers(spark, owing, team="M1"):
    rows = [(1, i, "KVW", team, False, "", str(o)) for i, o in enumerate(owing)]
    return spark.createDataFrame(
        rows, "org_id int, person_id long, problem string, team_code string, is_supervisor boolean, coach_of string, o string"
    ).select("org_id", "person_id", "problem", "team_code", "is_supervisor", "coach_of",
             F.col("o").cast("decimal(20,6)").alias("owing_min"))


@pytest.mark.parametrize("people, shifts, slots, want", [(2, 2, 1, 2), (3, 3, 1, 3), (5, 1, 2, 2)])
def test_every_slot_is_filled_once(spark, people, shifts, slots, want):
    spans = [(660 + 150 * i, 780 + 150 * i) for i in range(shifts)]
    cands = make_cands(spark, spans, slots, people)
    run = A.assign(cands, make_workers(spark, [100] * people), PLAYER, least_gain=1.0)
    assert run.roster.count() == want and run.uncovered().isEmpty()
    assert score.violations(run.roster, run.workers, cands, PLAYER).isEmpty()


def test_uncoverable_slot_is_reported(spark):
    # One member cannot serve two shifts at the same time.
    cands = make_cands(spark, [(660, 780), (700, 800)], 1, 1)
    run = A.assign(cands, make_workers(spark, [500]), PLAYER, least_gain=1.0)
    assert run.uncovered().count() == 1
    assert tuples(run.status(), "n_slots", "n_filled", "status") == [(2, 1, "partial")]


def test_optional_cover_skips_what_does_not_pay(spark):
    cands = make_cands(spark, [(600, 780), (800, 860)], 1, 1)
    # Owing 180 minutes pays for the long shift; the short one would only add cost.
    run = A.assign(cands, make_workers(spark, [180]), TEAM, cover="at_most_one")
    assert tuples(run.roster, "shift_id") == [("s0",)]
    with pytest.raises(ValueError, match="could not be filled"):
        run.require_complete()
    full = A.assign(cands, make_workers(spark, [180]), TEAM).require_complete()
    assert full.roster.count() == 2


def test_fixed_slot_is_kept(spark):
    cands = make_cands(spark, [(660, 780), (800, 900)], 1, 3)
    fixed = spark.createDataFrame([(1, "s0", 0, 2)], "org_id int, shift_id string, slot_nr int, person_id long")
    run = A.assign(cands, make_workers(spark, [500, 500, 0]), PLAYER, fixed=fixed, least_gain=1.0)
    assert (0, 2) in [(r.slot_nr, r.person_id) for r in run.roster.filter("shift_id = 's0'").collect()]
    assert score.violations(run.roster, run.workers, cands, PLAYER, fixed=fixed).isEmpty()


def test_objective_between_optimum_and_bound(spark):
    owing = [200, 120, 60]
    spans = [(600, 720), (720, 840), (840, 900), (900, 1080)]
    cands = make_cands(spark, spans, 1, 3)
    workers = make_workers(spark, owing)
    costs = spark.createDataFrame([], "org_id int, shift_id string, team_code string, cost long")

    def cost(choice):
        load = [0] * 3
        for (s, e), p in zip(spans, choice):
            load[p] += e - s
        return sum(5 * max(a - o, 0) + max(o - a, 0) for a, o in zip(load, owing)) + 90 * len(spans)

    best = min(cost(c) for c in itertools.product(range(3), repeat=len(spans)))
    run = A.assign(cands, workers, TEAM)
    got = float(score.score(run.roster, workers, cands, costs, TEAM).first().objective)
    bound = float(score.lower_bound(workers, cands, costs, TEAM).first().lower_bound)
    assert bound <= best <= got <= best * 1.25


@pytest.mark.parametrize("rules, name", [(TEAM, "_chains"), (PLAYER, "_improve")])
def test_each_club_is_improved_until_its_own_gains_are_small(spark, monkeypatch, rules, name):
    """A club that still gains 30 % a round is not stopped by another with a far larger objective."""
    small = make_cands(spark, [(660, 780)], 1, 2)
    cands = small.unionByName(small.withColumn("org_id", F.lit(2)))
    workers = make_workers(spark, [500, 500])
    rich = workers.withColumn("org_id", F.lit(2)).withColumn("owing_min", F.lit("9000000").cast("decimal(20,6)"))
    seen = []

    def scripted(state, first, second, **options):
        going = second if name == "_improve" else first
        seen.append([r.org_id for r in going.collect()])
        gain = 300.0 if len(seen) <= 3 else 0.0
        moves = state.chosen.filter("org_id = 1").withColumn("gain", F.lit(gain)).filter("gain > 0")
        return moves.select(*A.SLOT, "problem", "person_id", "gain")

    if name == "_chains":
        monkeypatch.setattr(A, name, lambda state, going, linked: scripted(state, going, None))
    else:
        monkeypatch.setattr(A, name, scripted)
    A.assign(cands, workers.unionByName(rich), rules)
    # Team mode leaves after one quiet round and starts again with chains.
    want = [[1, 2], [1], [1], [1], [1, 2]] if name == "_chains" else [[1, 2], [1, 2], [1], [1], [1]]
    assert [sorted(orgs) for orgs in seen] == want


def lane_cands(spark, shifts):
    """One slot each: (minutes, {team: cost})."""
    import datetime as dt

    rows = [
        (1, f"s{i}", dt.date(2000, 1, 8), 600, 600 + m, "Kasse", "KVW", 1, 1, m, team, False, "", 1, cost)
        for i, (m, teams) in enumerate(shifts) for team, cost in teams.items()
    ]
    return spark.createDataFrame(rows, make_cands(spark, [(0, 1)], 1, 1).schema)


def lane_workers(spark, owing):
    parts = [make_workers(spark, [o], t).withColumn("person_id", F.lit(i).cast("long")) for i, (t, o) in enumerate(owing.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


def state_of(spark, cands, workers, held):
    """A state with the given owner of each shift."""
    from rotaloom.plans.scratch import Scratch

    slots = C.open_slots(cands).select(*A.UNIT, "slot_nr")
    rows = [(1, "KVW", f"s{i}", 0, p, False) for i, p in enumerate(held)]
    chosen = spark.createDataFrame(rows, "org_id int, problem string, shift_id string, slot_nr int, person_id long, is_fixed boolean")
    return A._State(TEAM, slots, A._lanes(cands), workers, chosen, Scratch(spark))


def exchanged(spark, cands, workers, held, linked):
    state = state_of(spark, cands, workers, held)
    before = A._objectives(state).first().objective
    moves = A._chains(state, A._objectives(state), linked).collect()
    for r in moves:
        held[int(r.shift_id[1:])] = r.person_id
    after = A._objectives(state_of(spark, cands, workers, held)).first().objective
    assert after == pytest.approx(before - sum(r.gain for r in moves))
    return held, before - after


def test_a_giver_hands_over_as_many_slots_as_pay(spark):
    cands = lane_cands(spark, [(60, {"M1": 90, "M2": 90})] * 6)
    workers = lane_workers(spark, {"M1": 120, "M2": 240})
    held, gain = exchanged(spark, cands, workers, [0] * 6, False)
    assert held.count(0) == 2 and gain == 4 * 60 * 6


def test_swap_of_two_slots(spark):
    cands = lane_cands(spark, [(60, {"M1": 90, "M2": 20}), (60, {"M1": 20, "M2": 90}), (200, {"M1": 90}), (180, {"M2": 90})])
    workers = lane_workers(spark, {"M1": 260, "M2": 240})
    held = [0, 1, 0, 1]
    assert exchanged(spark, cands, workers, list(held), False) == (held, 0)
    assert exchanged(spark, cands, workers, list(held), True) == ([1, 0, 0, 1], 140)
    lengths = lane_cands(spark, [(100, {"M1": 90, "M2": 90}), (70, {"M1": 90, "M2": 90})])
    assert exchanged(spark, lengths, lane_workers(spark, {"M1": 70, "M2": 100}), [0, 1], True)[0] == [1, 0]


def test_ejection_over_a_third_member(spark):
    cands = lane_cands(spark, [(60, {"M1": 90, "M2": 90}), (60, {"M2": 90, "M3": 90})])
    workers = lane_workers(spark, {"M1": 0, "M2": 60, "M3": 60})
    held, gain = exchanged(spark, cands, workers, [0, 1], True)
    assert held == [1, 2] and gain == 6 * 60


LONG = pytest.mark.skipif(not os.environ.get("ROTALOOM_LONG"), reason="takes minutes; set ROTALOOM_LONG=1")


@pytest.mark.parametrize("rules", [TEAM, pytest.param(PLAYER, marks=LONG)])
def test_a_club_is_planned_alike_alone_and_beside_others(make_games, make_persons, rules):
    games, persons = random_season(make_games, make_persons, 5)
    more, others = random_season(make_games, make_persons, 6)
    rows = lambda season: tuples(season.assign().roster.filter("org_id = 1"), "shift_id", "slot_nr", "person_id")
    first = persons.select("org_id").first().org_id
    one = games.filter(F.col("org_id") == first).withColumn("org_id", F.lit(1))
    people = persons.filter(F.col("org_id") == first).withColumn("org_id", F.lit(1))
    both = [df.withColumn("org_id", F.col("org_id") + 10) for df in (more, others)]
    alone = rows(Season(one, people, rules))
    assert alone and alone == rows(Season(one.unionByName(both[0]), people.unionByName(both[1]), rules))


def test_player_mode_assignment_keeps_every_rule(player_season):
    season, _ = player_season
    run = season.assign()
    rules = {r[0] for r in tuples(score.violations(run.roster, run.workers, season.free, PLAYER), "rule")}
    assert rules <= {"N1"}
    missing = run.uncovered().count()
    assert score.violations(run.roster, run.workers, season.free, PLAYER).count() == missing
    gains = [r["gain"] for r in run.rounds if r["step"] == "improve"]
    assert all(g >= 0 for g in gains)


def test_assignment_does_not_depend_on_partitions(spark, make_games, make_persons):
    games, persons = random_season(make_games, make_persons, 3)
    rosters = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        run = Season(games.repartition(int(n)), persons.repartition(int(n)), TEAM).assign(least_gain=1.0)
        rosters.append(tuples(run.roster, "org_id", "shift_id", "slot_nr", "person_id"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rosters[0] and rosters[0] == rosters[1]


def test_model_tables_agree_with_the_scorer(player_season):
    season, pairs = player_season
    built = model.build_model(pairs, season.active, PLAYER)
    for roster in (season.simple_roster, season.assign(least_gain=1.0).roster):
        solution = model.solution_of(roster, built, pairs, season.active)
        priced = {(r.org_id, r.problem): (r.objective, r.n_missing) for r in model.objective(built, solution).collect()}
        scored = score.score(roster, season.active, season.free, season.costs, PLAYER).collect()
        for r in scored:
            value, missing = priced[r.org_id, r.problem]
            assert missing == 0 and value == pytest.approx(float(r.objective), abs=1e-3)
        found = score.violations(roster, season.active, season.free, PLAYER).groupBy("rule").count()
        rules = {r.rule for r in found.collect()}
        kinds = {r.row.split("/")[0] for r in model.broken_rows(built, solution).collect()}
        assert kinds == rules
        assert model.broken_domains(built, solution).isEmpty()
        assert model.broken_sets(built, solution).isEmpty()
    sizes = model.model_size(built).collect()
    assert all(r.n_vars > 0 and r.n_coefs >= r.n_vars for r in sizes)


def test_linear_rows_and_missing_values(spark):
    keys = "org_id int, problem string"
    choices = [(1, "p", f"x{i}", "BOOL", 0.0, 1.0, 1.0) for i in range(10)]
    built = model.Model(
        spark.createDataFrame(choices, f"{keys}, var string, type string, lb double, ub double, obj_coef double"),
        spark.createDataFrame([(1, "p", "five", "=", 5.0), (1, "p", "six", "=", 6.0)],
                              f"{keys}, row string, op string, rhs double"),
        spark.createDataFrame([(1, "p", row, f"x{i}", 1.0) for row in ("five", "six") for i in range(10)],
                              f"{keys}, row string, var string, coef double"),
        spark.createDataFrame([(1, "p", "one", 1, f"x{i}") for i in range(3)],
                              f"{keys}, set string, max_nonzero int, var string"),
    )
    for n in range(11):
        values = [(1, "p", f"x{i}", 1.0 if i < n else 0.0) for i in range(10)]
        solution = spark.createDataFrame(values, f"{keys}, var string, value double")
        if n in (0, 5, 6):
            broken = {r.row for r in model.broken_rows(built, solution).collect()}
            assert broken == {"five", "six"} - ({"five"} if n == 5 else {"six"} if n == 6 else set())
            assert model.broken_sets(built, solution).count() == (1 if n > 1 else 0)
    half = spark.createDataFrame([(1, "p", "x0", 0.5)], f"{keys}, var string, value double")
    assert model.broken_domains(built, half).count() == 1
    assert model.objective(built, half).first().objective is None
    assert model.objective(built, half, ignore_missing=True).first().objective == 0.5


def test_model_text_has_one_line_per_term(player_season):
    season, pairs = player_season
    built = model.build_model(pairs, season.active, PLAYER)
    lines = model.model_lines(built)
    assert lines.filter("section = 2 and part = 1").count() == built.coefs.count()
    assert lines.filter("line = 'End'").count() == built.rows.select("org_id", "problem").distinct().count()


def test_disjoin_pieces(spark):
    df = spark.createDataFrame([(1, 10, 30), (1, 20, 40), (1, 50, 60)], "k int, start_min int, end_min int")
    rows = tuples(disjoin.disjoin(df, ["k"]), "piece_start", "piece_end", "start_min")
    assert rows == [(10, 20, 10), (20, 30, 10), (20, 30, 20), (30, 40, 20), (50, 60, 50)]
    assert tuples(disjoin.coverage(df, ["k"]), "piece_start", "piece_end", "n_covering") == [
        (10, 20, 1), (20, 30, 2), (30, 40, 1), (50, 60, 1)
    ]


def test_salted_join_equals_plain_join(spark):
    big = spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k long, s string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = salted_join(big, small, ["k"], how, ["v"], 8)
        assert tuples(salted, *salted.columns) == tuples(big.join(small, "k", how), *salted.columns)
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], "full", ["v"], 8)


def test_spread_numbering_is_exact_on_a_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 7).alias("c"), "id"
    )
    tie = F.pmod("id", F.lit(16))
    got = spread_row_number(df, ["k"], [F.col("c")], tie, [F.col("id")], "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("c", F.pmod("id", F.lit(16)), "id")))
    assert tuples(got, "id", "n") == tuples(want.withColumn("n", F.col("n").cast("long")), "id", "n")


def test_layout_pads_the_shorter_side(make_games, make_persons):
    games = make_games(
        (1, "2000-01-08", "16:00", True, "M2"), (1, "2000-01-08", "11:00", False, "M3"),
        (1, "2000-01-11", "11:00", False, "M3"),
    )
    persons = make_persons((1, 1, "M1", 0, None), (1, 2, "Aufsicht", 0, None))
    season = Season(games, persons, TEAM)
    layout = report.roster_layout(
        season.full(season.simple_roster), season.shifts, games, season.people, TEAM
    ).orderBy("shift_date", "row_nr").collect()
    lines = [r.line for r in layout]
    assert lines == [
        "08.01.2000;15:00;18:00;Verkauf;M1;2;;;;;;;;;;16:00;M-KL;H;A",
        "08.01.2000;15:00;19:00;Aufsicht;Aufsicht;1;P2 X;;;;;;;;;11:00;M-KL;H;A",
    ]


def test_layout_can_show_unfilled_shifts(make_games, make_persons):
    games = make_games((1, "2000-01-08", "16:00", True, "M2"))
    season = Season(games, make_persons((1, 1, "M1", 0, None)), TEAM)
    full = season.full(season.simple_roster)
    count = lambda **o: report.roster_layout(
        full, season.shifts, games, season.people, TEAM, **o).filter("duty_type = 'Aufsicht'").count()
    assert (count(), count(include_unfilled=True)) == (0, 1)


def test_statistics_sections(make_games, make_persons):
    games = make_games((1, "2000-01-08", "16:00", True, "M2"), (1, "2000-01-09", "10:00", True, "gE1"))
    persons = make_persons((1, 1, "M1", 30, None), (1, 2, "Aufsicht", 15, None), (1, 3, "Aufsicht", 60, None))
    season = Season(games, persons, TEAM)
    full = season.full(season.simple_roster)
    people = season.people
    person = report.person_stats(full, season.shifts, people, season.targets, TEAM)
    got = {r.label: (r.worked_min, r.planned_min, r.total_min) for r in person.collect()}
    # M1 sells 3 hours for two; parents sell 2 hours with two helpers.
    assert got["Platzhalter M1"] == (30, 360, 390) and got["Eltern gE1"] == (0, 240, 240)
    idle = report.idle_stats(full, season.shifts, people, season.workers, TEAM)
    team = report.team_stats(full, season.shifts, people, TEAM)
    assert tuples(team, "team_code", "planned_min", "team_size") == [("M1", 360, 1), ("gE1", 240, 1)]
    lines = report.stats_lines(person, team, idle).collect()
    assert {r.section for r in lines} >= {0, 1, 2}
    assert any(r.line.startswith("Gesamtsumme Team;M1;30;360;390;1;390,0") for r in lines)


@pytest.mark.parametrize("rules", [TEAM, PLAYER], ids=["team", "player"])
def test_plans_have_no_cross_products_or_python(player_season, rules, make_games, make_persons):
    season = Season(*random_season(make_games, make_persons, 2), rules)
    plans = [
        S.all_shifts(S.kickoffs(season.games), rules),
        C.candidates(season.shifts, season.workers, season.windows, rules),
        C.free_candidates(season.candidates, season.kickoffs),
        score.score(season.simple_roster, season.active, season.free, season.costs, rules),
        score.violations(season.simple_roster, season.active, season.free, rules),
    ]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "PythonUDF" not in text and "ArrowEvalPython" not in text
