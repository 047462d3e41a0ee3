"""Planned minutes per duty type and target minutes per team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.operators.shifts import is_parent_sales
from rotaloom.rules import SUPERVISION, SUPERVISOR_TEAM, Rules

# Capacities are summed as whole millionths, so totals do not depend on the
# order in which partial sums meet.
_UNIT = 1_000_000


def planned_minutes(shifts: DataFrame) -> DataFrame:
    """Person-minutes per duty type over the shifts members have to fill."""
    return (
        shifts.filter(~is_parent_sales(F.col("duty_type"), F.col("parents_of")))
        .groupBy("org_id", "duty_type")
        .agg(F.sum((F.col("end_min") - F.col("start_min")) * F.col("n_people")).alias("planned_min"))
    )


def target_minutes(headcounts: DataFrame, planned: DataFrame, rules: Rules) -> DataFrame:
    """Minutes each team (team mode) or each member should work in the season."""
    team = F.col("team_code")
    supervises = team == SUPERVISOR_TEAM
    capacity = F.create_map(
        *[F.lit(v) for t in rules.teams for v in (t.code, round(t.capacity * _UNIT))]
    )
    helping = F.col("n_persons") - F.when(supervises, F.lit(0)).otherwise(F.col("n_coaches"))
    sized = headcounts.withColumn("effective", (F.element_at(capacity, team) * helping).cast("long"))
    totals = sized.groupBy("org_id").agg(
        F.sum(F.when(~supervises, F.col("effective"))).alias("effective_players"),
        F.sum(F.when(~supervises, F.col("worked_min"))).alias("worked_players"),
        F.sum(F.when(supervises, F.col("n_persons"))).alias("n_supervisors"),
        F.sum(F.when(supervises, F.col("worked_min"))).alias("worked_supervisors"),
    )
    supervision = F.col("duty_type") == SUPERVISION
    plan = planned.groupBy("org_id").agg(
        F.sum(F.when(~supervision, F.col("planned_min"))).alias("planned_players"),
        F.sum(F.when(supervision, F.col("planned_min"))).alias("planned_supervisors"),
    )

    def zero(name: str):
        return F.coalesce(F.col(name), F.lit(0))

    per_org = totals.join(plan, "org_id", "left").select(
        "org_id",
        F.try_divide(
            (zero("planned_players") + zero("worked_players")).cast("double"),
            F.col("effective_players") / float(_UNIT),
        ).alias("minutes_per_player"),
        F.try_divide(
            (zero("planned_supervisors") + zero("worked_supervisors")).cast("double"),
            F.col("n_supervisors").cast("double"),
        ).alias("minutes_per_supervisor"),
    )
    team_total = (F.col("effective") / float(_UNIT)) * F.when(
        supervises, F.col("minutes_per_supervisor")
    ).otherwise(F.col("minutes_per_player"))
    per_head = team_total / F.col("n_persons")
    target = F.when(F.lit(rules.team_mode) & ~supervises, team_total).otherwise(per_head)
    # Six decimals are far below a minute and make every later sum exact.
    return sized.join(per_org, "org_id").select(
        "org_id",
        "team_code",
        "n_persons",
        "worked_min",
        F.round(target, 6).alias("target_min"),
    )
