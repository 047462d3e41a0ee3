"""Candidate assignments.

Whether a person may take a shift depends on three attributes only: the team,
being a supervisor, and the team they coach.  Persons that agree in them form a
*class*, and candidates are kept as one row per (shift, class) with the number
of persons behind it.  Classes per organisation and distinct shifts per day are
bounded by the dimensions, so the table grows with the shifts and never with
shifts times members.  ``expand`` lists single persons where a caller needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.functions.dates import other_weekend_day
from rotaloom.functions.intervals import Span, blocked_window, contains, intersects, span, span_distance
from rotaloom.operators.people import PARENT_PREFIX, parent_key
from rotaloom.operators.availability import playing_days
from rotaloom.operators.shifts import home_kickoffs, is_parent_sales
from rotaloom.plans.skew import growing, salted_join
from rotaloom.rules import DAY_END, SUPERVISION, WIPING, Rules

CLASS = ["org_id", "team_code", "is_supervisor", "coach_of"]
SHIFT = ["org_id", "shift_id"]
NOBODY = ""


def _shift_span() -> Span:
    return span("start_min", "end_min")


def with_class(persons: DataFrame) -> DataFrame:
    """Persons with a null-free coaching attribute, ready for joins on ``CLASS``."""
    return persons.withColumn("coach_of", F.coalesce(F.col("trains_team"), F.lit(NOBODY)))


def worker_classes(persons: DataFrame) -> DataFrame:
    return with_class(persons).groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n_persons"))


def problem_of(duty_type: Column) -> Column:
    """Supervision and the other duties are planned independently."""
    return F.when(duty_type == SUPERVISION, "A").otherwise("KVW")


def slot_count(rules: Rules) -> Column:
    """One slot per shift in team mode, one per helper otherwise."""
    return F.lit(1) if rules.team_mode else F.col("n_people")


def slot_minutes(rules: Rules) -> Column:
    """Minutes one filled slot adds to its worker's season total."""
    length = F.col("end_min") - F.col("start_min")
    if not rules.team_mode:
        return length
    return length * F.when(F.col("duty_type") == SUPERVISION, 1).otherwise(F.col("n_people"))


def may_work_at(rules: Rules) -> Column:
    """P6 over a row that holds a shift, a class and the team's working window."""
    window = Span(F.col("work_from"), F.when(F.col("work_to") >= DAY_END, 2 * DAY_END).otherwise(F.col("work_to")))
    wipes = rules.has_flag(F.col("team_code"), "wiper_duty")
    return (
        contains(window, _shift_span())
        & ((F.col("duty_type") == WIPING) == wipes)
        & ((F.col("duty_type") == SUPERVISION) == F.col("is_supervisor"))
    )


def member_shifts(shifts: DataFrame) -> DataFrame:
    """Shifts members have to fill, that is all but the parents' sales."""
    return shifts.filter(~is_parent_sales(F.col("duty_type"), F.col("parents_of")))


def candidates(shifts: DataFrame, persons: DataFrame, windows: DataFrame, rules: Rules) -> DataFrame:
    """G1: every shift with every class allowed to take it and free at that time."""
    spark = shifts.sparkSession
    dim = rules.dim_team(spark).select("team_code", "work_from", "work_to")
    classes = worker_classes(persons).join(dim, "team_code")
    # A day's windows are bounded by teams times minutes.  They travel with its shifts, so that candidates are
    # made where their shifts are and never dealt out again.
    own = windows.groupBy("org_id", "shift_date").agg(
        F.collect_list(F.struct("team_code", "block_from", "block_to")).alias("_windows")
    )

    def taken(window: Column) -> Column:
        overlap = intersects(_shift_span(), Span(window["block_from"], window["block_to"]))
        return ((window["team_code"] == F.col("team_code")) | (window["team_code"] == F.col("coach_of"))) & overlap

    return (
        member_shifts(shifts)
        .join(growing(own), ["org_id", "shift_date"], "left")
        .join(growing(classes), "org_id")
        .filter(may_work_at(rules))
        .filter(~F.coalesce(F.exists("_windows", taken), F.lit(False)))
        .select(
            *SHIFT,
            "shift_date",
            "start_min",
            "end_min",
            "duty_type",
            problem_of(F.col("duty_type")).alias("problem"),
            "n_people",
            slot_count(rules).alias("n_slots"),
            slot_minutes(rules).alias("minutes"),
            *CLASS[1:],
            "n_persons",
        )
    )


def weekend_flags(cands: DataFrame, kicks: DataFrame) -> DataFrame:
    """W1 and W2 as flags: the team plays on the other weekend day; the shift keeps someone anyway."""
    playing = playing_days(kicks).groupBy("org_id", F.col("shift_date").alias("_day")).agg(
        F.collect_set("team_code").alias("_playing")
    )
    other_day = other_weekend_day(F.col("shift_date"))
    plays = other_day.isNotNull() & F.array_contains("_playing", F.col("team_code"))
    flagged = (
        cands.withColumn("_day", F.coalesce(other_day, F.col("shift_date")))
        .join(growing(playing), ["org_id", "_day"], "left")
        .withColumn("plays_other_day", F.coalesce(plays, F.lit(False)))
        .drop("_playing")
    )
    # A shift has at most as many rows as there are classes.  The day goes with the shift and is named here
    # because rows are dealt out by it already.
    kept = F.max(~F.col("plays_other_day")).over(Window.partitionBy("org_id", "_day", "shift_id"))
    return flagged.withColumn("shift_keeps_some", kept).drop("_day")


def weekend_filtered(cands: DataFrame, kicks: DataFrame) -> DataFrame:
    """W1 alone."""
    return weekend_flags(cands, kicks).filter("not plays_other_day").drop("plays_other_day", "shift_keeps_some")


def readded(cands: DataFrame, kicks: DataFrame) -> DataFrame:
    """W2 alone: all candidates of shifts that W1 would leave empty."""
    return weekend_flags(cands, kicks).filter("not shift_keeps_some").drop("plays_other_day", "shift_keeps_some")


def free_candidates(cands: DataFrame, kicks: DataFrame) -> DataFrame:
    """W1 followed by W2 in one pass."""
    return (
        weekend_flags(cands, kicks)
        .filter("not plays_other_day or not shift_keeps_some")
        .drop("plays_other_day", "shift_keeps_some")
    )


def uncovered_shifts(shifts: DataFrame, cands: DataFrame, on_uncovered: str = "report") -> DataFrame:
    """Member shifts without any candidate; ``fail`` raises if there are some."""
    missing = member_shifts(shifts).join(growing(cands.select(*SHIFT).distinct()), SHIFT, "left_anti")
    if on_uncovered == "fail" and not missing.isEmpty():
        raise ValueError("some shifts have no candidate")
    return missing


def parent_assignments(shifts: DataFrame, rules: Rules) -> DataFrame:
    """parents' shifts go to the placeholder of their team, one row per helper."""
    return (
        shifts.filter(is_parent_sales(F.col("duty_type"), F.col("parents_of")))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n_people") - 1)).alias("slot_nr"))
        .select(
            *SHIFT,
            "slot_nr",
            parent_key(F.col("parents_of"), rules).alias("person_id"),
            F.concat(F.lit(PARENT_PREFIX), F.col("parents_of")).alias("name"),
            F.lit(True).alias("is_fixed"),
        )
    )


def proximity_costs(shifts: DataFrame, kicks: DataFrame, rules: Rules) -> DataFrame:
    """M3: summed distance to close home games per (shift, team); other pairs cost the flat amount."""
    window = blocked_window(F.col("start_min"), F.lit(True), rules)
    home = (
        home_kickoffs(kicks).select(
            "org_id", "shift_date", "team_code", "n_games",
            window.start.alias("block_from"), window.end.alias("block_to"),
        )
    )
    distance = span_distance(_shift_span(), span("block_from", "block_to"))
    return (
        member_shifts(shifts)
        .select(*SHIFT, "shift_date", "start_min", "end_min")
        .join(growing(home), ["org_id", "shift_date"])
        .withColumn("distance", distance)
        .filter(F.col("distance") <= rules.near_game_min)
        .groupBy(*SHIFT, "team_code")
        .agg(F.sum(F.col("distance") * F.col("n_games")).alias("cost"))
    )


def with_cost(cands: DataFrame, costs: DataFrame, rules: Rules) -> DataFrame:
    return cands.join(growing(costs), [*SHIFT, "team_code"], "left").withColumn(
        "cost", F.coalesce(F.col("cost"), F.lit(rules.flat_cost)).cast("long")
    )


def expand(cands: DataFrame, persons: DataFrame, rules: Rules) -> DataFrame:
    """One row per (shift, slot, person), for model export and for the checks of a given roster.

    A class has many shifts and few members, so shifts are dealt out and members repeated.
    """
    members = with_class(persons).select(*CLASS, "person_id", "worked_min")
    pairs = salted_join(cands.drop("n_persons"), members, CLASS, "inner", ["shift_id"], rules.salts)
    return pairs.withColumn("slot_nr", F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1)))


def merge_fixed(
    fixed: DataFrame, cands: DataFrame, persons: DataFrame, rules: Rules
) -> tuple[DataFrame, DataFrame]:
    """Resolve fixed rows to candidates; returns (assignments, rejects with a reason).

    ``fixed`` holds org_id, shift_date, start_min, end_min, duty_type, team_code,
    name and slot_nr.  Each row is looked up, so the work grows with the fixed
    rows and not with the candidates.  A name that several members of a team have,
    a time at which several such shifts run, and a slot fixed for several persons
    are rejects; the returned assignments fill each slot once.
    """
    named = with_class(persons).groupBy("org_id", "team_code", "name").agg(
        F.count(F.lit(1)).alias("_named"),
        *[F.min(c).alias(c) for c in ("person_id", "is_supervisor", "coach_of")],
    )
    resolved = fixed.join(growing(named), ["org_id", "team_code", "name"], "left")
    times = ["org_id", "shift_date", "start_min", "end_min", "duty_type", *CLASS[1:]]
    # Hardly two candidates agree in these, so they are dealt out once instead of being sorted and combined before.
    offered = cands.select(*times, "shift_id", "n_slots").repartition(*times).groupBy(*times).agg(
        F.min("shift_id").alias("shift_id"), F.max("shift_id").alias("_last_shift"), F.max("n_slots").alias("n_slots")
    )
    matched = resolved.join(growing(offered), times, "left").withColumn(
        "reason",
        F.when(F.col("person_id").isNull(), "person not found")
        .when(F.col("_named") > 1, "ambiguous name")
        .when(F.col("shift_id").isNull() | (F.col("slot_nr") >= F.col("n_slots")), "no such candidate")
        .when(F.col("shift_id") != F.col("_last_shift"), "ambiguous shift"),
    )
    good = F.col("reason").isNull()
    slot = Window.partitionBy(*SHIFT, "slot_nr", good)
    clash = F.min("person_id").over(slot) != F.max("person_id").over(slot)
    matched = matched.withColumn("reason", F.when(good & clash, "slot fixed twice").otherwise(F.col("reason")))
    assignments = matched.filter("reason is null").select(
        *SHIFT, F.col("slot_nr").cast("int").alias("slot_nr"), "person_id", F.lit(True).alias("is_fixed")
    )
    rejects = matched.filter("reason is not null").select(*fixed.columns, "reason")
    return assignments.distinct(), rejects


def shift_facts(cands: DataFrame) -> DataFrame:
    """What a shift is, one row per shift that has candidates.

    All candidates of a shift agree in these columns.  As a grouping key the duty is hashed, while a ``first`` of a text
    would sort all candidates before the shuffle.
    """
    return _facts(cands, [*SHIFT, "duty_type"])


def slot_facts(cands: DataFrame) -> DataFrame:
    """``shift_facts`` without the duty, dealt out by shift once."""
    return _facts(cands, SHIFT)


def _facts(cands: DataFrame, keys: list[str]) -> DataFrame:
    numbers = ["shift_date", "start_min", "end_min", "n_people", "n_slots", "minutes"]
    supervised = F.max(F.col("problem") == "A").alias("_supervised")
    found = cands.groupBy(*keys).agg(*[F.first(c).alias(c) for c in numbers], supervised)
    return found.withColumn("problem", F.when(F.col("_supervised"), "A").otherwise("KVW")).drop("_supervised")


def open_slots(cands: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """Slots still to be filled: one row per (shift, slot) that has candidates and is not fixed."""
    slots = shift_facts(cands).withColumn("slot_nr", F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1)))
    if fixed is not None:
        slots = slots.join(fixed.select(*SHIFT, "slot_nr"), [*SHIFT, "slot_nr"], "left_anti")
    return slots
