"""A season from files to files, and the rules around fixed rows and text."""

import os

import pytest
from conftest import tuples
from pyspark.sql import functions as F
from test_candidates import PLAYER, TEAM

from rotaloom.operators import candidates as C
from rotaloom.operators import score
from rotaloom.plans import job, scratch
from rotaloom.rules import DutyRule, Rules, TeamRule
from rotaloom.sources import text_files as X

GAMES = """Nummer;Staffel;Datum;Zeit;Halle;Heim;Gast;Hallenname
1001;F-LL;08.01.2000;16:00;4066;SC Example 2;TV Other;Hall A
1002;F-LL;08.01.2000;18:00;4066;SC Example;TV Other;Hall A
1003;M-BK;08.01.2000;20:00;4066;SC Example;TV Other;Hall A
1004;mJC-KL;09.01.2000;10:00;4066;SC Example;TV Other;Hall A
bad line
"""


def write(folder, name, text, charset="utf-8"):
    place = folder / name / "org_id=1"
    os.makedirs(place)
    (place / "in.csv").write_text(text, encoding=charset)


@pytest.fixture
def season_files(tmp_path):
    people = [f"P{i} {t};{t};;;{i}" for t in ("M1", "M2", "F1", "F2", "mC1") for i in range(5)]
    people += [f"Sup{i} Visor;;;x;0" for i in range(4)] + ["P0 M1;M1;;;0", "Ed Epsilon;ZZ9;;;4"]
    write(tmp_path, "games", GAMES, "latin-1")
    write(tmp_path, "persons", "\n".join(people) + "\n")
    return tmp_path


def clubs(spark):
    return spark.createDataFrame([(1, "SC Example", "4066")], "org_id int, club string, venue string")


def lines(folder):
    parts = sorted(f for f in os.listdir(folder / "org_id=1") if f.startswith("part-"))
    return [x for f in parts for x in (folder / "org_id=1" / f).read_text().splitlines()]


def test_files_to_files(spark, season_files, tmp_path):
    write(season_files, "fixed", "Sa, 08.01.00;19:00;23:00;Aufsicht;Aufsicht;Sup1 Visor\nSa, 08.01.00;19:00;23:00;Aufsicht;Aufsicht;Nobody\n")
    out = job.run_season(spark, str(season_files), str(tmp_path / "out"), clubs(spark), TEAM)
    assert out.run.uncovered().isEmpty() and out.season.violations(out.run.roster).isEmpty()
    roster = lines(tmp_path / "out" / "roster")
    assert any("19:00;23:00;Aufsicht" in line and "Sup1 Visor" in line for line in roster)
    # Every chosen slot stands in the layout, and the minutes of the report add up.
    full = out.season.full(out.run.roster)
    assert sum(line.split(";")[1] != "" for line in roster) == full.select("shift_id").distinct().count()
    stats = lines(tmp_path / "out" / "stats")
    assert stats[0].startswith("Name;Team;") and any(s.startswith("Kein Dienst") for s in stats)
    planned = sum(int(s.split(";")[3]) for s in stats[1:] if s.split(";")[0] not in ("Gesamtsumme Team", "Kein Dienst"))
    shifts = out.season.shifts.selectExpr("sum((end_min - start_min) * n_people) as m").first().m
    assert planned == shifts
    reasons = sorted(r.reason for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect())
    assert reasons == ["bad date", "person not found", "repeated line", "unknown team"]
    metrics = dict(spark.read.parquet(str(tmp_path / "out" / "metrics")).select("metric", "value").collect())
    assert metrics["fixed"] == 1 and metrics["rejects"] == 4 and metrics["games"] == 4


def test_stops_on_request(spark, season_files, tmp_path):
    people = season_files / "persons" / "org_id=1" / "in.csv"
    people.write_text("\n".join(x for x in people.read_text().splitlines() if "Visor" not in x) + "\n")
    with pytest.raises(ValueError, match="no candidate"):
        job.run_season(spark, str(season_files), str(tmp_path / "out"), clubs(spark), TEAM, on_uncovered="fail")


def parse_fixed(spark, *values, rules=TEAM, layout=None):
    rows = spark.createDataFrame([(1, v) for v in values], "org_id int, value string")
    return X.parse_fixed(rows, rules, layout=layout)


def test_fixed_shift_past_midnight_and_many_helpers(spark):
    good, bad = parse_fixed(
        spark, "Sa, 08.01.00;21:00;00:30;Verkauf;M1;Ann;Bob;Cy", "Sa, 08.01.00;00:30;02:00;Verkauf;M1;Di", "Sa, 08.01.00;09:00;12:00;Kasse;M1;Ed"
    )
    assert bad.isEmpty()
    assert tuples(good, "start_min", "end_min", "slot_nr", "name") == [
        (540, 720, 0, "Ed"), (1260, 1470, 0, "Ann"), (1260, 1470, 1, "Bob"), (1260, 1470, 2, "Cy"), (1470, 1560, 0, "Di"),
    ]


def test_wide_duty_shows_and_reads_eight_helpers(spark):
    wide = Rules(duties=(DutyRule("Verkauf", "V", 8, 60, 120, (5, 6)), *TEAM.duties[1:]))
    assert wide.helper_columns == 8 and TEAM.helper_columns == 6
    good, _ = parse_fixed(spark, "08.01.2000;15:00;18:30;Verkauf;M1;8;a;b;c;d;e;f;g;h;;;;16:00;L;H;A", rules=wide, layout=X.ROSTER_FIELDS)
    assert tuples(good, "slot_nr", "name") == list(enumerate("abcdefgh"))


def test_many_teams(spark):
    rules = Rules(teams=tuple(TeamRule(f"T{i}", 1.0, 0, 1440) for i in range(1200)))
    assert rules.dim_team(spark).count() == 1200


def candidate_rows(spark, shift_ids, n_slots=2):
    import datetime as dt

    rows = [
        (1, s, dt.date(2000, 1, 8), 660 + 200 * i, 780 + 200 * i, "Kasse", "KVW", n_slots, n_slots, 120, "M1", False, "", 3, 90)
        for i, s in enumerate(shift_ids)
    ]
    return spark.createDataFrame(
        rows,
        "org_id int, shift_id string, shift_date date, start_min int, end_min int, duty_type string, problem string, n_people int, "
        "n_slots int, minutes int, team_code string, is_supervisor boolean, coach_of string, n_persons long, cost long",
    )


def test_fixed_rows_are_unique_per_slot(spark):
    import datetime as dt

    cands = candidate_rows(spark, ["s0", "s1"])
    persons = spark.createDataFrame(
        [(1, i, n, "M1", 0, False, None) for i, n in enumerate(["Ann", "Bob", "Twin", "Twin"])],
        "org_id int, person_id long, name string, team_code string, worked_min int, is_supervisor boolean, trains_team string",
    )
    day = dt.date(2000, 1, 8)
    rows = [
        (1, day, 660, 780, "Kasse", "M1", "Ann", 0), (1, day, 660, 780, "Kasse", "M1", "Bob", 0),
        (1, day, 660, 780, "Kasse", "M1", "Twin", 1), (1, day, 860, 980, "Kasse", "M1", "Ann", 0),
        (1, day, 860, 980, "Kasse", "M1", "Ann", 7),
    ]
    fixed = spark.createDataFrame(
        rows, "org_id int, shift_date date, start_min int, end_min int, duty_type string, team_code string, name string, slot_nr int"
    )
    good, bad = C.merge_fixed(fixed, cands, persons, PLAYER)
    assert tuples(good, "shift_id", "slot_nr", "person_id") == [("s1", 0, 0)]
    assert sorted(r.reason for r in bad.collect()) == ["ambiguous name", "no such candidate", "slot fixed twice", "slot fixed twice"]


def test_checker_sees_unknown_slots_shifts_and_persons(spark):
    cands = candidate_rows(spark, ["s0"], n_slots=1)
    workers = spark.createDataFrame(
        [(1, 1, "KVW", "M1", False, "")], "org_id int, person_id long, problem string, team_code string, is_supervisor boolean, coach_of string"
    ).withColumn("owing_min", F.lit(100).cast("decimal(20,6)"))
    roster = spark.createDataFrame(
        [(1, "s0", 0, 1), (1, "s0", 7, 1), (1, "zz", 0, 1), (1, "s0", 0, 99)], "org_id int, shift_id string, slot_nr int, person_id long"
    )
    found = tuples(score.violations(roster, workers, cands, TEAM), "rule", "shift_id", "slot_nr")
    assert found == [("CANDIDATE", "s0", 0), ("N1", "s0", 0), ("SLOT", "s0", 7), ("SLOT", "zz", 0)]


def test_fixed_row_may_use_what_the_weekend_rule_removed(spark):
    every = candidate_rows(spark, ["s0", "s1"], n_slots=1)
    other = every.withColumn("team_code", F.lit("F1"))
    workers = spark.createDataFrame(
        [(1, 1, "KVW", "M1", False, ""), (1, 2, "KVW", "F1", False, "")],
        "org_id int, person_id long, problem string, team_code string, is_supervisor boolean, coach_of string",
    )
    roster = spark.createDataFrame([(1, "s0", 0, 1), (1, "s1", 0, 2)], "org_id int, shift_id string, slot_nr int, person_id long")
    fixed = roster.filter("person_id = 1")
    free, all_cands = other, other.unionByName(every)
    assert tuples(score.violations(roster, workers, free, TEAM, fixed), "rule") == [("CANDIDATE",)]
    assert score.violations(roster, workers, free, TEAM, fixed, all_cands).isEmpty()


def test_results_do_not_depend_on_salts(spark, make_games, make_persons):
    from test_candidates import random_season

    from rotaloom.operators import report
    from rotaloom.plans.season import Season

    games, persons = random_season(make_games, make_persons, 3)
    seen = []
    for salts in (4, 32):
        rules = TEAM.with_(salts=salts)
        season = Season(games, persons, rules)
        roster = season.assign().roster
        layout = report.roster_layout(season.full(roster), season.shifts, season.games, season.people, rules)
        seen.append((tuples(roster, "org_id", "shift_id", "slot_nr", "person_id"), tuples(layout, "org_id", "shift_date", "row_nr", "line")))
    assert seen[0] == seen[1]


def test_a_run_leaves_only_its_result_tables(spark, make_games, make_persons, monkeypatch, tmp_path):
    from test_candidates import random_season

    from rotaloom.operators import assign as A
    from rotaloom.plans.season import Season

    season = Season(*random_season(make_games, make_persons, 5), TEAM)
    free, active = season.free, season.active
    monkeypatch.setattr(scratch, "folder", lambda _: str(tmp_path))
    A.assign(free, active, TEAM)
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "rotaloom").iterdir()) == ["chosen", "slots"]


def test_scratch_needs_a_shared_place(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return "file:/home/x/spark-warehouse" if key == scratch.WAREHOUSE else default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="shared folder"):
        scratch.folder(Session())
    Session.sparkContext.master = "local[4]"
    assert scratch.folder(Session()) == "file:/home/x/spark-warehouse/_scratch"
