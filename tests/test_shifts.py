import math

import pytest
from conftest import minutes, tuples

from rotaloom.operators import shifts as S
from rotaloom.operators import targets as T
from rotaloom.rules import DUTIES, Rules

RULES = Rules()
DAY_A = [
    (1, "2000-01-08", "16:00", True, "F2"),
    (1, "2000-01-08", "18:00", True, "F1"),
    (1, "2000-01-08", "20:00", True, "M1"),
]
DAY_B = [
    (1, "2000-01-09", "10:00", True, "mC1"),
    (1, "2000-01-09", "11:30", True, "gE1"),
    (1, "2000-01-09", "13:00", True, "wD1"),
    (1, "2000-01-09", "17:00", True, "M2"),
]


def spans(df, duty, parents=False):
    rows = df.filter(f"duty_type = '{duty}' and parents_of is {'not ' if parents else ''}null")
    return tuples(rows, "start_min", "end_min")


def m(*texts):
    return sorted((minutes(a), minutes(b)) for a, b in (t.split("-") for t in texts))


def test_day_a(make_games):
    shifts = S.all_shifts(S.kickoffs(make_games(*DAY_A)), RULES)
    assert spans(shifts, "Aufsicht") == m("15:00-19:00", "19:00-23:00")
    assert spans(shifts, "Verkauf") == m("15:00-18:30", "18:30-22:00")
    assert spans(shifts, "Kasse") == m("15:00-18:00", "18:00-20:30")
    assert spans(shifts, "Wischen") == m("17:45-19:15")
    planned = dict(tuples(T.planned_minutes(shifts), "duty_type", "planned_min"))
    assert planned == {"Aufsicht": 480, "Verkauf": 840, "Kasse": 330, "Wischen": 180}


def test_day_b(make_games):
    shifts = S.all_shifts(S.kickoffs(make_games(*DAY_B)), RULES)
    chain = tuples(shifts.filter("parents_of is not null"), "parents_of", "start_min", "end_min")
    assert chain == sorted([("mC1", 540, 660), ("gE1", 660, 750), ("wD1", 750, 840)])
    assert spans(shifts, "Verkauf") == m("14:00-16:30", "16:30-19:00")
    assert spans(shifts, "Aufsicht") == m("09:00-12:30", "12:30-16:00", "16:00-20:00")
    assert spans(shifts, "Kasse") == [] and spans(shifts, "Wischen") == []


def test_away_games_make_no_shifts(make_games):
    games = make_games((1, "2000-01-08", "16:00", False, "M1"))
    assert S.all_shifts(S.kickoffs(games), RULES).isEmpty()


def test_early_team_alone_opens_cash_earlier(make_games):
    games = make_games((1, "2000-01-08", "18:00", True, "F1"))
    shifts = S.all_shifts(S.kickoffs(games), RULES)
    # 17:30 padded by 60 before and 30 after.
    assert spans(shifts, "Kasse") == m("16:30-18:00")


def test_copies_of_a_game_change_nothing_but_the_cash_end(make_games):
    once = S.all_shifts(S.kickoffs(make_games(*DAY_B)), RULES)
    twice = S.all_shifts(S.kickoffs(make_games(*DAY_B, *DAY_B)), RULES)
    assert tuples(once.filter("parents_of is null"), "shift_id") == tuples(twice.filter("parents_of is null"), "shift_id")


def test_second_parent_game_replaces_the_first(make_games):
    games = make_games(
        (1, "2000-01-09", "10:00", True, "mC1"),
        (1, "2000-01-09", "12:00", True, "gE1"),
        (1, "2000-01-09", "14:00", True, "mC1"),
    )
    chain = tuples(S.parent_shifts(S.kickoffs(games), RULES), "parents_of", "start_min", "end_min")
    assert chain == [("gE1", 690, 810), ("mC1", 810, 900)]


def test_equal_kick_offs_chain_in_key_order(make_games):
    games = make_games((1, "2000-01-09", "10:00", True, "mC1"), (1, "2000-01-09", "10:00", True, "gE1"))
    chain = tuples(S.parent_shifts(S.kickoffs(games), RULES), "parents_of", "start_min", "end_min")
    assert chain == [("gE1", 570, 660), ("mC1", 540, 570)]


def test_parents_selling_past_the_last_player_game_is_rejected(make_games):
    games = make_games((1, "2000-01-09", "10:00", True, "M2"), (1, "2000-01-09", "16:00", True, "mC1"))
    kicks = S.kickoffs(games)
    assert tuples(S.shift_rejects(kicks, RULES), "duty_type", "range_start", "range_end") == [("Verkauf", 1020, 720)]
    assert spans(S.all_shifts(kicks, RULES), "Verkauf") == []


def test_past_midnight_is_kept_and_flagged(make_games):
    games = make_games((1, "2000-01-08", "22:00", True, "M2"))
    late = S.all_shifts(S.kickoffs(games), RULES).filter("past_midnight")
    assert tuples(late, "duty_type", "end_min") == [("Aufsicht", 1500)]


def test_two_wiper_games(make_games):
    games = make_games((1, "2000-01-08", "14:00", True, "F1"), (1, "2000-01-08", "18:00", True, "F1"))
    kicks = S.kickoffs(games)
    assert tuples(S.wiper_conflicts(kicks, RULES), "n_games") == [(2,)]
    assert S.wiper_shifts(kicks, RULES).count() == 2


def _walk(start, end, lengths):
    """Cut a range shift by shift; None where nothing sensible comes out."""
    total = end // 30 - start // 30
    best, best_loss = None, None
    for h in lengths:
        times = total / h
        loss = abs(times - math.floor(times + 0.5))
        if best is None or loss < best_loss:
            best, best_loss = h, loss
    step = 30 * min(total, best)
    if step <= 0:
        return None
    out = [(start, start + step)]
    while out[-1][1] < end:
        out.append((out[-1][1], min(out[-1][1] + step, end)))
    if out[-1][1] - out[-1][0] < 60:
        if len(out) == 1:
            return None
        last = out.pop()
        out[-1] = (out[-1][0], max(out[-1][1], last[1]))
    return out


@pytest.mark.parametrize("duty", [d for d in DUTIES], ids=lambda d: d.duty_type)
def test_cutting_against_a_walk(spark, duty):
    import datetime as dt

    ranges = [(s, e) for s in range(480, 1080, 25) for e in range(s - 40, 1440, 35)]
    rows = [(i, dt.date(2000, 1, 1), duty.duty_type, s, e) for i, (s, e) in enumerate(ranges)]
    df = spark.createDataFrame(
        rows, "org_id int, shift_date date, duty_type string, range_start int, range_end int"
    )
    got = {}
    for r in S.cut_ranges(df, RULES).select("org_id", "start_min", "end_min").collect():
        got.setdefault(r[0], []).append((r[1], r[2]))
    for i, (s, e) in enumerate(ranges):
        assert sorted(got.get(i, [])) == (_walk(s, e, duty.lengths_hh) or []), (s, e)
