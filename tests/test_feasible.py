"""Witnesses of moments that cannot be filled, and ordered sets, by brute force."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import day
from rotaloom.operators import feasible, model

graphs = st.integers(1, 4).flatmap(
    lambda n: st.tuples(
        st.lists(st.integers(1, 4), min_size=n, max_size=n),
        st.lists(st.tuples(st.integers(1, 5), st.sets(st.integers(0, n - 1), min_size=1)), max_size=5),
    )
)


@settings(max_examples=300, deadline=None)
@given(graphs)
def test_worst_set_by_all_sets(graph):
    slots, classes = graph
    needs = dict(enumerate(slots))
    able = {s: [c for c, (_, shifts) in enumerate(classes) if s in shifts] for s in needs}
    members = {c: n for c, (n, _) in enumerate(classes)}

    def excess(shifts):
        return sum(needs[s] for s in shifts) - sum(members[c] for c in {c for s in shifts for c in able[s]})

    sets = [frozenset(x) for k in range(len(needs) + 1) for x in itertools.combinations(needs, k)]
    most = max(map(excess, sets))
    found, witness = feasible.worst_set(needs, members, able)
    assert found == most
    assert witness == min((x for x in sets if excess(x) == most), key=len)


FREE = (
    "org_id int, shift_date date, shift_id string, start_min int, end_min int, problem string, n_slots int, "
    "team_code string, is_supervisor boolean, coach_of string, n_persons long"
)


def test_impossible_day_with_its_witness(spark):
    d, e = day("2000-09-02"), day("2000-09-03")

    def row(org, date, shift, start, end, slots, team, n, problem="KVW"):
        return (org, date, shift, start, end, problem, slots, team, False, "", n)

    rows = [
        # Two shifts at once need four members, and only three of team a may take either; a third has its own.
        row(1, d, "s1", 600, 720, 2, "a", 3), row(1, d, "s2", 660, 780, 2, "a", 3), row(1, d, "s3", 660, 780, 1, "b", 1),
        # The same shifts one after the other can be filled.
        row(2, d, "s1", 600, 660, 2, "a", 3), row(2, d, "s2", 660, 780, 2, "a", 3),
        # Another team helps out.
        row(1, e, "s4", 600, 720, 2, "a", 3), row(1, e, "s5", 600, 720, 2, "a", 3), row(1, e, "s5", 600, 720, 2, "b", 1),
        # Supervision is not bound to one place at a time.
        row(3, d, "s6", 600, 720, 2, "a", 1, "A"),
    ]
    free = spark.createDataFrame(rows, FREE)
    got = [tuple(r) for r in feasible.impossible_moments(free).collect()]
    assert got == [(1, d, 660, 4, 3, ["s1", "s2"])]
    assert feasible.impossible_moments(free.limit(0)).count() == 0


@pytest.mark.parametrize("with_weight", [True, False])
def test_ordered_sets(spark, with_weight):
    keys = "org_id int, problem string"
    chosen = {"a": "110", "b": "101", "c": "011", "d": "111", "e": "100", "f": "000"}
    sets = [(1, "p", s, 2, f"{s}{i}", float(-i)) for s in chosen for i in range(3)] * 2  # a repeated member counts once
    table = spark.createDataFrame(sets, f"{keys}, set string, max_nonzero int, var string, weight double")
    table = table if with_weight else table.drop("weight")
    values = [(1, "p", f"{s}{i}", float(v)) for s, on in chosen.items() for i, v in enumerate(on)]
    solution = spark.createDataFrame(values, f"{keys}, var string, value double")
    got = {(r.set, r.n_nonzero, r.n_between) for r in model.broken_sets(model.Model(None, None, None, table), solution).collect()}
    assert got == {("b", 2, 1), ("d", 3, 0)}


def test_status_names_what_is_proven(spark):
    from rotaloom.operators.assign import Assignment

    slot = "org_id int, shift_id string, slot_nr int, problem string"
    slots = spark.createDataFrame([(o, "s", i, "KVW") for o in (1, 2, 3) for i in (0, 1)], slot)
    roster = spark.createDataFrame([(1, "s", 0), (2, "s", 0), (3, "s", 0), (3, "s", 1)], "org_id int, shift_id string, slot_nr int")
    witness = spark.createDataFrame([(1, day("2000-09-02"), 600, 2, 1, ["s"])] * 2 + [(3, day("2000-09-02"), 600, 2, 1, ["s"])], feasible.WITNESS)
    run = Assignment(roster, slots, None)
    assert {r.org_id: r.status for r in run.status(witness).collect()} == {1: "infeasible", 2: "partial", 3: "complete"}
    assert run.status().columns == run.status(witness).columns


def test_classes_that_take_the_same_shifts_are_judged_as_one(spark):
    d = day("2000-09-02")
    rows = [
        (1, d, s, 600, 720, "KVW", 3, team, False, coach, 1) for s in ("s1", "s2") for team in "ab" for coach in ("", "c")
    ] + [(1, d, "s2", 600, 720, "KVW", 3, "d", False, "", 1)]
    found = feasible.impossible_moments(spark.createDataFrame(rows, FREE))
    assert [tuple(r) for r in found.collect()] == [(1, d, 600, 6, 5, ["s1", "s2"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
