import datetime as dt
import random

from conftest import tuples

from rotaloom.operators import availability, candidates as C
from rotaloom.operators import people, score
from rotaloom.operators import shifts as S
from rotaloom.plans.season import Season
from rotaloom.rules import TEAMS, Rules

PLAYER = Rules(team_mode=False)
TEAM = Rules()


def random_season(make_games, make_persons, seed, org_count=2):
    rng = random.Random(seed)
    codes = [t.code for t in TEAMS if t.code not in ("Aufsicht", "None", "Minis")]
    works = [t.code for t in TEAMS if t.work_to > 0 and t.code not in ("Aufsicht", "None")]
    games = [
        (rng.randrange(org_count), f"2000-01-{rng.choice([7, 8, 9, 15, 16]):02d}",
         f"{rng.randrange(9, 21):02d}:{rng.choice(['00', '30'])}", rng.random() < 0.7, rng.choice(codes))
        for _ in range(60)
    ]
    persons = [
        (org, 100 * org + i, "Aufsicht" if i % 7 == 0 else rng.choice(works), rng.randrange(0, 200),
         rng.choice(codes) if rng.random() < 0.3 else None)
        for org in range(org_count) for i in range(40)
    ]
    return make_games(*games), make_persons(*persons)


def brute_force(shifts, persons, games, rules):
    teams = {t.code: t for t in rules.teams}
    windows = [
        (g.org_id, g.game_date, g.team_code, g.start_min - (60 if g.is_home else 120),
         g.start_min + (120 if g.is_home else 180))
        for g in games
    ]

    def busy(s, team):
        return any(
            w[0] == s.org_id and w[1] == s.shift_date and w[2] == team and w[3] <= s.end_min and s.start_min <= w[4]
            for w in windows
        )

    out = set()
    for s in shifts:
        if s.parents_of is not None:
            continue
        for p in persons:
            t = teams[p.team_code]
            fits = t.work_to >= 1440 or s.end_min <= t.work_to
            if (
                p.org_id == s.org_id and fits and (s.duty_type == "Wischen") == t.wiper_duty
                and (s.duty_type == "Aufsicht") == p.is_supervisor
                and not busy(s, p.team_code) and not busy(s, p.trains_team)
            ):
                out |= {(s.org_id, s.shift_id, k, p.person_id) for k in range(s.n_people)}
    return out


def test_candidates_and_weekend_rule_against_brute_force(make_games, make_persons):
    games, persons = random_season(make_games, make_persons, 5)
    season = Season(games, persons, PLAYER)
    shifts, people_, game_rows = season.shifts.collect(), season.members.collect(), games.collect()
    cands = C.candidates(season.shifts, season.members, season.windows, PLAYER)
    keys = ("org_id", "shift_id", "slot_nr", "person_id")
    want = brute_force(shifts, people_, game_rows, PLAYER)
    assert want and set(tuples(C.expand(cands, season.members, PLAYER), *keys)) == want

    by_shift = {(s.org_id, s.shift_id): s for s in shifts}
    team_of = {(p.org_id, p.person_id): p.team_code for p in people_}
    plays = {(g.org_id, g.team_code, g.game_date) for g in game_rows}

    def dropped(row):
        s = by_shift[row[:2]]
        step = {5: 1, 6: -1}.get(s.shift_date.weekday())
        return step and (s.org_id, team_of[row[0], row[3]], s.shift_date + dt.timedelta(days=step)) in plays

    kept = {r for r in want if not dropped(r)}
    emptied = {r[:2] for r in want} - {r[:2] for r in kept}
    free = C.free_candidates(cands, season.kickoffs)
    got = set(tuples(C.expand(free, season.members, PLAYER), *keys))
    assert kept < want and got == kept | {r for r in want if r[:2] in emptied}
    uncovered = {(s.org_id, s.shift_id) for s in shifts if s.parents_of is None} - {r[:2] for r in got}
    assert set(tuples(C.uncovered_shifts(season.shifts, free), "org_id", "shift_id")) == uncovered


def test_emptied_shift_gets_everybody_back(make_games, make_persons):
    games = make_games((1, "2000-01-08", "18:00", True, "M2"), (1, "2000-01-09", "12:00", False, "M3"))
    persons = make_persons((1, 1, "M3", 0, None), (1, 2, "Aufsicht", 0, None))
    season = Season(games, persons, TEAM)
    sales = season.candidates.filter("duty_type = 'Verkauf'")
    assert sales.count() > 0
    assert C.weekend_filtered(sales, season.kickoffs).isEmpty()
    assert C.readded(sales, season.kickoffs).count() == sales.count()
    assert C.free_candidates(sales, season.kickoffs).count() == sales.count()


def test_late_shift_is_open_to_all_day_teams_only(make_games, make_persons):
    games = make_games((1, "2000-01-08", "22:30", True, "M2"))
    persons = make_persons((1, 1, "M3", 0, None), (1, 2, "mA1", 0, None), (1, 3, "Aufsicht", 0, None))
    season = Season(games, persons, TEAM)
    late = season.candidates.filter("end_min > 1440")
    assert {r[0] for r in tuples(late, "team_code")} == {"M3", "Aufsicht"}


def test_parents_are_fixed_once_per_helper(make_games):
    shifts = S.parent_shifts(S.kickoffs(make_games((1, "2000-01-09", "10:00", True, "gE1"))), TEAM)
    rows = tuples(C.parent_assignments(shifts, TEAM), "slot_nr", "name", "is_fixed")
    assert rows == [(0, "Eltern gE1", True), (1, "Eltern gE1", True)]


def test_fixed_rows_are_resolved_or_rejected(spark, make_games, make_persons):
    games = make_games((1, "2000-01-08", "18:00", True, "M2"))
    persons = make_persons((1, 1, "M3", 0, None), (1, 2, "M3", 0, None), (1, 3, "Aufsicht", 0, None))
    season = Season(games, persons, PLAYER)
    shift = season.candidates.filter("duty_type = 'Verkauf'").orderBy("start_min").first()
    base = (1, shift.shift_date, shift.start_min, shift.end_min, "Verkauf", "M3")
    fixed = spark.createDataFrame(
        [(*base, "P1 X", 0), (*base, "Nobody", 1), (*base, "P2 X", 5), (*base[:2], 1, 2, *base[4:], "P2 X", 0)],
        "org_id int, shift_date date, start_min int, end_min int, duty_type string, team_code string, name string, "
        "slot_nr int",
    )
    good, bad = C.merge_fixed(fixed, season.candidates, season.workers, PLAYER)
    assert tuples(good, "shift_id", "slot_nr", "person_id") == [(shift.shift_id, 0, 1)]
    assert tuples(bad, "name", "reason") == [
        ("Nobody", "person not found"), ("P2 X", "no such candidate"), ("P2 X", "no such candidate"),
    ]
    slots = C.open_slots(season.candidates.filter(f"shift_id = '{shift.shift_id}'"), good)
    assert tuples(slots, "slot_nr") == [(1,)]


def test_person_filters(spark, make_persons):
    persons = make_persons(
        (1, 1, "M1", 100, "mA1"), (1, 2, "M1", 100, None), (1, 3, "M1", 155, None), (1, 4, "mA1", 0, "mA2"),
    )
    targets = spark.createDataFrame([(1, "M1", 200.0), (1, "mA1", 100.0)], "org_id int, team_code string, target_min double")
    left = people.unfinished_persons(persons, targets, PLAYER)
    # 1 coaches youth as an active player, 3 is within 45 minutes of the target.
    assert [r[0] for r in tuples(left, "person_id")] == [2, 4]


def test_small_youth_teams_count_ten(make_persons):
    persons = make_persons(*[(1, i, "mA1", 10, None) for i in range(3)], *[(1, 10 + i, "M1", 10, "mA1") for i in range(3)])
    rows = tuples(people.headcounts(persons, TEAM), "team_code", "n_persons", "worked_min", "n_coaches")
    assert rows == [("M1", 3, 30, 3), ("mA1", 10, 30, 0)]


def test_no_supervisors_gives_no_supervision_target(make_games, make_persons):
    games = make_games((1, "2000-01-08", "16:00", True, "M2"))
    season = Season(games, make_persons((1, 1, "M3", 0, None)), TEAM)
    assert [r[0] for r in tuples(season.targets, "team_code")] == ["M3"]
    assert {r[0] for r in tuples(season.uncovered, "duty_type")} == {"Aufsicht"}
    assert score.active_workers(season.workers, season.free, season.targets, TEAM).count() == 1


def test_proximity_golden_values(make_games, make_persons):
    games = make_games(
        (1, "2000-01-08", "16:00", True, "F2"), (1, "2000-01-08", "18:00", True, "F1"),
        (1, "2000-01-08", "20:00", True, "M1"),
    )
    kicks = S.kickoffs(games)
    shifts = S.all_shifts(kicks, TEAM).filter("duty_type = 'Verkauf'")
    costs = C.proximity_costs(shifts, kicks, TEAM)
    got = {(r.shift_id.split("/")[2], r.team_code): r.cost for r in costs.collect()}
    assert got["1110-1320", "F2"] == 30 and got["900-1110", "M1"] == 30
    windows = tuples(availability.team_windows(kicks, TEAM), "team_code", "block_from", "block_to")
    assert windows == [("F1", 1020, 1200), ("F2", 900, 1080), ("M1", 1140, 1320)]
