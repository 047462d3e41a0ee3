import os

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from rotaloom.rules import Rules
from rotaloom.sinks import export
from rotaloom.sources import text_files as X

RULES = Rules()
GAMES = """Nummer;Staffel;Datum;Zeit;Halle;Heim;Gast;Hallenname
1001;F-LL;08.01.2000;16:00;H1;SC Example 2;TV Other;Hall A
1002;mJA-KL;08.01.2000;18:00;H1;SC Example;SG Dritte Fünf;Hall A
1003;M-BK;09.01.2000;17:30;9999;TSV Fourth;SC Example;Hall B
1004;M-BK;09.01.2000;17:30;9999;TSV Fourth;TV Other;Hall B
bad line
"""
PERSONS = """Ann Alpha;F1;;;6,5
Bob Beta;M1;mA1;;0
Cy Gamma;;;x;3,25
Di Delta;;;;0
Ed Epsilon;ZZ9;;;4
"Flo Fi;M2;;;1,5"
Gus Gamma;gE1;;;2
Hal Eta;M1;;
"""


@pytest.fixture
def clubs(spark):
    return spark.createDataFrame([(1, "SC Example", "H1")], "org_id int, club string, venue string")


def write(folder, text, charset):
    path = os.path.join(folder, "org_id=1")
    os.makedirs(path)
    with open(os.path.join(path, "data.csv"), "w", encoding=charset) as out:
        out.write(text)
    return str(folder)


def test_games(spark, clubs, tmp_path):
    rows, rejects = X.load_games(spark, write(tmp_path, GAMES, "latin-1"), clubs, RULES)
    assert tuples(rows, "game_id", "team_code", "is_home", "start_min", "away") == [
        (1001, "F2", True, 960, "TV Other"), (1002, "mA1", True, 1080, "SG Dritte Fünf"),
        (1003, "M1", False, 1050, "SC Example"),
    ]
    assert tuples(rejects, "value", "reason")[1] == ("bad line", "bad date")
    assert rejects.count() == 2
    late, _ = X.load_games(spark, str(tmp_path), clubs, RULES, after="2000-01-08")
    assert tuples(late, "game_id") == [(1003,)]


def test_comma_separated_games(spark, clubs):
    lines = spark.createDataFrame(
        [(1, '"1001","F-LL","08.01.2000","16:00","H1","SC Example 2","TV Other","Hall, A"')],
        "org_id int, value string",
    )
    rows, rejects = X.parse_games(lines, clubs, RULES, sep=",")
    assert tuples(rows, "team_code", "is_home") == [("F2", True)] and rejects.isEmpty()


def test_persons(spark, tmp_path):
    rows, rejects = X.load_persons(spark, write(tmp_path, PERSONS, "utf-8"), RULES)
    assert tuples(rows, "name", "team_code", "worked_min", "is_supervisor", "trains_team") == [
        ("Ann Alpha", "F1", 390, False, None), ("Bob Beta", "M1", 0, False, "mA1"),
        ("Cy Gamma", "Aufsicht", 195, True, None), ("Flo Fi", "M2", 90, False, None),
    ]
    assert tuples(rejects, "reason") == [("bad hours",), ("unknown team",)]


def test_failfast(spark, tmp_path):
    rows, _ = X.load_persons(spark, write(tmp_path, PERSONS, "utf-8"), RULES, mode="failfast")
    with pytest.raises(Exception, match="unknown team|bad hours"):
        rows.collect()


def test_fixed(spark):
    lines = spark.createDataFrame(
        [
            (1, "Sa, 08.01.00;15:00;18:30;Verkauf;M1;Ann Alpha;Bob Beta"),
            (1, "So, 09.01.00;15:00;18:30;Kasse;M1;Ann Alpha"),
            (1, "So, 09.01.00;15:00;18:30;Tanzen;M1;Ann Alpha"),
        ],
        "org_id int, value string",
    )
    rows, rejects = X.parse_fixed(lines, RULES)
    got = tuples(rows.withColumn("d", F.col("shift_date").cast("string")), "d", "duty_type", "slot_nr", "name")
    assert got == [
        ("2000-01-08", "Verkauf", 0, "Ann Alpha"), ("2000-01-08", "Verkauf", 1, "Bob Beta"),
        ("2000-01-09", "Kasse", 0, "Ann Alpha"),
    ]
    assert tuples(rejects, "reason") == [("unknown duty type",)]
    exported = spark.createDataFrame(
        [(1, "08.01.2000;15:00;18:30;Verkauf;M1;2;Ann Alpha;Bob Beta;;;;")], "org_id int, value string"
    )
    again, _ = X.parse_fixed(exported, RULES, layout=X.ROSTER_FIELDS)
    assert tuples(again, "slot_nr", "name") == [(0, "Ann Alpha"), (1, "Bob Beta")]


def test_export_keeps_order_and_charset(spark, tmp_path):
    rows = [(org, i, f"{i:03d};Fünf;;;") for org in (1, 2) for i in range(50)]
    lines = spark.createDataFrame(rows, "org_id int, nr int, line string").repartition(5)
    path = str(tmp_path / "out")
    export.write_lines(lines, ["org_id", "nr"], path, charset="ISO-8859-1")
    for org in (1, 2):
        folder = os.path.join(path, f"org_id={org}")
        parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
        text = "".join(open(os.path.join(folder, f), encoding="latin-1").read() for f in parts)
        assert text.splitlines() == [r[2] for r in rows if r[0] == org]
