from __future__ import annotations

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

GAME_SCHEMA = (
    "org_id int, game_id long, game_date date, start_min int, is_home boolean, team_code string, "
    "league string, home string, away string"
)
PERSON_SCHEMA = (
    "org_id int, person_id long, name string, team_code string, worked_min int, is_supervisor boolean, "
    "trains_team string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def minutes(text: str) -> int:
    hour, minute = text.split(":")
    return int(hour) * 60 + int(minute)


@pytest.fixture
def make_games(spark):
    def make(*rows):
        """Rows of (org, date, 'HH:MM', home?, team)."""
        data = [
            (org, i, day(d), minutes(t), home, team, team[:-1] + "-KL", "H", "A")
            for i, (org, d, t, home, team) in enumerate(rows)
        ]
        return spark.createDataFrame(data, GAME_SCHEMA)

    return make


@pytest.fixture
def make_persons(spark):
    def make(*rows):
        """Rows of (org, id, team, worked, trains); team Aufsicht marks supervisors."""
        data = [
            (org, pid, f"P{pid} X", team, worked, team == "Aufsicht", trains) for org, pid, team, worked, trains in rows
        ]
        return spark.createDataFrame(data, PERSON_SCHEMA)

    return make


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: [(v is None, v) for v in t])
