"""Head counts, team representatives and who still has to work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaloom.plans.skew import salted_join
from rotaloom.rules import SUPERVISOR_TEAM, Rules

PARENT_PREFIX = "Eltern "
REPRESENTATIVE_PREFIX = "Platzhalter "
# Placeholder persons get negative keys; members' keys are not negative.
PARENT_KEY_BASE = -1_000_000
PERSON_COLUMNS = ["org_id", "person_id", "name", "team_code", "worked_min", "is_supervisor", "trains_team"]


def short_name(name: Column) -> Column:
    """Initials of the first two words, or the name itself."""
    words = F.split(name, " ")
    return F.when(
        F.size(words) > 1, F.concat(F.substring(words[0], 1, 1), F.substring(F.element_at(words, 2), 1, 1))
    ).otherwise(name)


def is_parent_placeholder(name: Column) -> Column:
    """P9."""
    return name.startswith(PARENT_PREFIX)


def working_persons(persons: DataFrame, rules: Rules) -> DataFrame:
    """P5."""
    return persons.filter(rules.may_work(F.col("team_code"), F.col("is_supervisor")))


def headcounts(persons: DataFrame, rules: Rules) -> DataFrame:
    """A10: members, minutes worked and coaches per team; youth teams count at least ten."""
    counted = persons.groupBy("org_id", "team_code").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("worked_min").alias("worked_min"),
        F.count("trains_team").alias("n_coaches"),
    )
    floor = F.when(rules.has_flag(F.col("team_code"), "is_youth"), rules.min_youth_size).otherwise(0)
    return counted.select(
        "org_id",
        "team_code",
        F.greatest(F.col("members"), floor.cast("long")).alias("n_persons"),
        "worked_min",
        "n_coaches",
    )


def representatives(persons: DataFrame, rules: Rules) -> DataFrame:
    """One placeholder per team with the team's minutes; supervisors stay themselves."""
    plays = F.col("team_code") != SUPERVISOR_TEAM
    teams = (
        persons.filter(plays)
        .groupBy("org_id", "team_code")
        .agg(F.sum("worked_min").cast("int").alias("worked_min"))
        .select(
            "org_id",
            (-1 - rules.team_index(F.col("team_code"))).cast("long").alias("person_id"),
            F.concat(F.lit(REPRESENTATIVE_PREFIX), F.col("team_code")).alias("name"),
            "team_code",
            "worked_min",
            F.lit(False).alias("is_supervisor"),
            F.lit(None).cast("string").alias("trains_team"),
        )
    )
    return teams.unionByName(persons.filter(~plays).select(*PERSON_COLUMNS).distinct())


def workers(persons: DataFrame, rules: Rules) -> DataFrame:
    """Persons the roster is planned with: representatives in team mode, members otherwise."""
    able = working_persons(persons, rules)
    return representatives(able, rules) if rules.team_mode else able.select(*PERSON_COLUMNS)


def parent_key(team: Column, rules: Rules) -> Column:
    return (PARENT_KEY_BASE - rules.team_index(team)).cast("long")


def unfinished_persons(persons: DataFrame, targets: DataFrame, rules: Rules) -> DataFrame:
    """Drop who is close to the target and active players who coach youth."""
    coaches_youth = rules.has_flag(F.col("team_code"), "is_active") & F.coalesce(
        rules.has_flag(F.col("trains_team"), "is_youth"), F.lit(False)
    )
    left = persons.filter(~coaches_youth)
    goal = targets.select("org_id", "team_code", "target_min")
    return (
        salted_join(left, goal, ["org_id", "team_code"], "inner", ["person_id"], rules.salts)
        .filter(F.col("worked_min") < F.col("target_min") - rules.finished_slack_min)
        .select(*PERSON_COLUMNS)
    )
