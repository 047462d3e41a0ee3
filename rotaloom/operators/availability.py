"""When teams and coaches are taken by their own games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.functions.intervals import blocked_window
from rotaloom.rules import Rules


def team_windows(kicks: DataFrame, rules: Rules) -> DataFrame:
    """Distinct blocked windows per team and day, from home and away kick-offs."""
    window = blocked_window(F.col("start_min"), F.col("is_home"), rules)
    return kicks.select(
        "org_id",
        "shift_date",
        "team_code",
        window.start.alias("block_from"),
        window.end.alias("block_to"),
    ).distinct()


def team_blocks(kicks: DataFrame, persons: DataFrame, rules: Rules) -> DataFrame:
    """Windows of the teams that have persons in the import."""
    present = persons.select("org_id", "team_code").distinct()
    return team_windows(kicks, rules).join(present, ["org_id", "team_code"], "left_semi")


def coach_blocks(kicks: DataFrame, persons: DataFrame, rules: Rules) -> DataFrame:
    """Windows in which coaches are taken, with the number of coaches they block.

    Coaches of one team share its windows, so they are counted per team instead
    of being paired with every game one by one.
    """
    coaches = (
        persons.filter("trains_team is not null")
        .groupBy("org_id", F.col("trains_team").alias("team_code"))
        .agg(F.count(F.lit(1)).alias("n_coaches"))
    )
    return team_windows(kicks, rules).join(coaches, ["org_id", "team_code"])


def playing_days(kicks: DataFrame) -> DataFrame:
    return kicks.select("org_id", "team_code", "shift_date").distinct()
