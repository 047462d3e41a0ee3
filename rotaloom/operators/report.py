"""Working-time statistics, roster layout and run counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.functions.dates import format_german
from rotaloom.functions.intervals import clock
from rotaloom.operators.candidates import SHIFT, parent_assignments
from rotaloom.operators.people import PARENT_PREFIX, parent_key
from rotaloom.operators.shifts import is_parent_sales
from rotaloom.plans.scratch import materialize
from rotaloom.plans.skew import growing, salted_join, spread_row_number
from rotaloom.rules import SUPERVISION, Rules

PERSON = ["org_id", "person_id"]
DELIMITER = ";"


def with_parents(roster: DataFrame, shifts: DataFrame, rules: Rules) -> DataFrame:
    """The full roster: chosen slots plus the parents' fixed ones."""
    keys = [*SHIFT, "slot_nr", "person_id"]
    return roster.select(*keys).unionByName(parent_assignments(shifts, rules).select(*keys))


def roster_persons(persons: DataFrame, shifts: DataFrame, rules: Rules) -> DataFrame:
    """Planned workers plus the parent placeholders that occur."""
    columns = [*PERSON, "name", "team_code", "worked_min", "is_supervisor"]
    parents = (
        shifts.filter("parents_of is not null")
        .select("org_id", F.col("parents_of").alias("team_code"))
        .distinct()
        .select(
            "org_id",
            parent_key(F.col("team_code"), rules).alias("person_id"),
            F.concat(F.lit(PARENT_PREFIX), F.col("team_code")).alias("name"),
            "team_code",
            F.lit(0).alias("worked_min"),
            F.lit(False).alias("is_supervisor"),
        )
    )
    return persons.select(*columns).unionByName(parents)


def effective_minutes(roster: DataFrame, shifts: DataFrame, rules: Rules) -> DataFrame:
    """Planned minutes per person; a single team slot stands for all its helpers."""
    length = F.col("end_min") - F.col("start_min")
    single = F.lit(rules.team_mode) & ~is_parent_sales(F.col("duty_type"), F.col("parents_of"))
    return (
        roster.join(growing(shifts), SHIFT)
        .groupBy(*PERSON)
        .agg(F.sum(length * F.when(single, F.col("n_people")).otherwise(1)).alias("planned_min"))
    )


def group_means(effective: DataFrame, people: DataFrame) -> DataFrame:
    """Mean planned minutes of supervisors and of all others, one row per organisation."""
    known = effective.join(growing(people), PERSON)
    both = known.groupBy("org_id").agg(
        F.avg(F.when(F.col("is_supervisor"), F.col("planned_min"))).alias("s"),
        F.avg(F.when(~F.col("is_supervisor"), F.col("planned_min"))).alias("o"),
    )
    return both.select(
        "org_id",
        F.coalesce(F.col("s"), F.lit(0.0)).alias("mean_supervisors"),
        F.coalesce(F.col("o"), F.lit(0.0)).alias("mean_others"),
    )


def _mean():
    return F.when(F.col("is_supervisor"), F.col("mean_supervisors")).otherwise(F.col("mean_others"))


def _label():
    return F.concat(F.col("name"), F.when(F.col("is_supervisor"), " (A)").otherwise(""))


def person_stats(
    roster: DataFrame, shifts: DataFrame, people: DataFrame, targets: DataFrame, rules: Rules
) -> DataFrame:
    """One row per person with shifts."""
    effective = materialize(effective_minutes(roster, shifts, rules), "effective")
    total = F.col("worked_min") + F.col("planned_min")
    goals = targets.select("org_id", "team_code", "target_min")
    rows = salted_join(effective.join(growing(people), PERSON), goals, ["org_id", "team_code"], "left", ["person_id"], rules.salts)
    return (
        salted_join(rows, group_means(effective, people), ["org_id"], "inner", ["person_id"], rules.salts)
        .select(
            *PERSON,
            _label().alias("label"),
            "team_code",
            "worked_min",
            "planned_min",
            total.alias("total_min"),
            F.coalesce(F.col("target_min"), F.lit(0.0)).alias("target_min"),
            F.coalesce(total - F.col("target_min"), F.lit(0.0)).alias("off_target"),
            (total - _mean()).alias("off_mean"),
        )
    )


def team_stats(roster: DataFrame, shifts: DataFrame, people: DataFrame, rules: Rules) -> DataFrame:
    """R2: sums per team over persons with shifts, supervisors left out."""
    return (
        effective_minutes(roster, shifts, rules)
        .join(growing(people.filter("not is_supervisor")), PERSON)
        .groupBy("org_id", "team_code")
        .agg(
            F.sum("worked_min").alias("worked_min"),
            F.sum("planned_min").alias("planned_min"),
            F.sum(F.col("worked_min") + F.col("planned_min")).alias("total_min"),
            F.count(F.lit(1)).alias("team_size"),
        )
        .withColumn("mean_min", F.col("total_min") / F.col("team_size"))
    )


def idle_stats(roster: DataFrame, shifts: DataFrame, people: DataFrame, persons: DataFrame, rules: Rules) -> DataFrame:
    """Planned workers without any shift."""
    means = group_means(effective_minutes(roster, shifts, rules), people)
    idle = persons.join(growing(roster.select(*PERSON).distinct()), PERSON, "left_anti")
    return (
        salted_join(idle, means, ["org_id"], "left", ["person_id"], rules.salts)
        .withColumn("mean", F.coalesce(_mean(), F.lit(0.0)))
        .select(
            *PERSON,
            _label().alias("label"),
            "team_code",
            "worked_min",
            (F.col("worked_min") - F.col("mean")).alias("off_mean"),
        )
    )


def _decimal_comma(column):
    return F.replace(column.cast("string"), F.lit("."), F.lit(","))


def stats_lines(person: DataFrame, team: DataFrame, idle: DataFrame) -> DataFrame:
    """K2 as text: three sections per organisation, ordered by section and line."""

    def section(df: DataFrame, number: int, cells: list) -> DataFrame:
        line = F.concat_ws(DELIMITER, *[c.cast("string") for c in cells])
        return df.select("org_id", F.lit(number).alias("section"), line.alias("line"))

    c = F.col
    # Column titles and section words of the report.
    title = "Name;Team;Gearbeitet;Geplant;Gesamt;Sollzeit;Abweichung Sollzeit;Abweichung effektiver Durchschnitt"
    head = person.select("org_id").distinct()
    return (
        section(head, 0, [F.lit(title)])
        .unionByName(
            section(
                person, 1,
                [c("label"), c("team_code"), c("worked_min"), c("planned_min"), c("total_min"),
                 _decimal_comma(c("target_min")), _decimal_comma(c("off_target")), _decimal_comma(c("off_mean"))],
            )
        )
        .unionByName(
            section(
                team, 2,
                [F.lit("Gesamtsumme Team"), c("team_code"), c("worked_min"), c("planned_min"), c("total_min"),
                 c("team_size"), _decimal_comma(c("mean_min"))],
            )
        )
        .unionByName(
            section(
                idle, 3,
                [F.lit("Kein Dienst"), c("label"), c("team_code"), c("worked_min"), _decimal_comma(c("off_mean"))],
            )
        )
    )


def game_range(game_id):
    """A range of game keys, growing with the key, so ranges sort as the keys do.

    Running numbers come in ranges of 4096; hashed keys share 4096 ranges on either side.
    """
    wide = F.shiftright(game_id, 51)
    return F.when(game_id < 0, wide).when(game_id < 1 << 40, F.shiftright(game_id, 12)).otherwise(wide + (1 << 28))


def roster_layout(
    roster: DataFrame,
    shifts: DataFrame,
    games: DataFrame,
    people: DataFrame,
    rules: Rules,
    include_unfilled: bool = False,
) -> DataFrame:
    """K1: shifts of a day beside the games of that day, row by row.

    ``roster`` includes the parents' slots; shifts nobody serves appear only
    with ``include_unfilled``.  Games of one day are numbered in
    spread buckets, so a crowded day does not end up in a single task.
    """
    day = ["org_id", "shift_date"]
    named = roster.join(growing(people.select(*PERSON, "name", "team_code")), PERSON)
    helpers = [F.max(F.when(F.col("slot_nr") == i, F.col("name"))).alias(f"helper_{i + 1}")
               for i in range(rules.helper_columns)]
    per_shift = named.groupBy(*SHIFT).agg(
        F.min_by("team_code", F.struct("slot_nr", "person_id")).alias("team_code"), *helpers
    )
    shows_names = (
        F.lit(not rules.team_mode)
        | (F.col("duty_type") == SUPERVISION)
        | is_parent_sales(F.col("duty_type"), F.col("parents_of"))
    )
    in_day = Window.partitionBy(*day).orderBy("start_min", "end_min", "duty_type", "shift_id")
    game_days = games.select("org_id", F.col("game_date").alias("shift_date")).distinct()
    left = (
        shifts.join(growing(per_shift), SHIFT, "left" if include_unfilled else "inner")
        .join(growing(game_days), day, "left_semi")
        .select(
            *day,
            F.row_number().over(in_day).cast("long").alias("row_nr"),
            clock(F.col("start_min")).alias("from_time"),
            clock(F.col("end_min")).alias("to_time"),
            "duty_type",
            "team_code",
            "n_people",
            *[F.when(shows_names, F.col(f"helper_{i + 1}")).alias(f"helper_{i + 1}")
              for i in range(rules.helper_columns)],
        )
    )
    left = materialize(left, "layout")
    planned_days = left.select(*day).distinct()
    dated = games.withColumnRenamed("game_date", "shift_date")
    # Days are as many as the games allow, so they are not repeated for salts.
    day_games = dated.join(growing(planned_days), day, "left_semi")
    numbered = spread_row_number(
        day_games,
        day,
        [(~F.col("is_home")).cast("int"), F.col("start_min")],
        game_range(F.col("game_id")),
        [F.col("game_id")],
    )
    right = numbered.select(
        *day, "row_nr", "game_id", clock(F.col("start_min")).alias("game_time"), "league", "home", "away"
    )
    wide = left.join(growing(right), [*day, "row_nr"], "full")

    def cell(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    line = F.concat_ws(
        DELIMITER,
        format_german(F.col("shift_date")),
        *[cell(n) for n in ("from_time", "to_time", "duty_type", "team_code", "n_people")],
        *[cell(f"helper_{i + 1}") for i in range(rules.helper_columns)],
        *[F.lit("")] * 3,
        *[cell(n) for n in ("game_time", "league", "home", "away")],
    )
    return wide.withColumn("line", line)


def run_metrics(games: DataFrame, shifts: DataFrame, cands: DataFrame, kept: DataFrame, rules: Rules) -> DataFrame:
    """K5: run counters per organisation as (metric, value) rows."""

    def counted(df: DataFrame, **aggregates) -> DataFrame:
        totals = df.groupBy("org_id").agg(*[a.cast("long").alias(n) for n, a in aggregates.items()])
        return totals.unpivot("org_id", list(aggregates), "metric", "value")

    length = (F.col("end_min") - F.col("start_min")) * F.col("n_people")
    parents = is_parent_sales(F.col("duty_type"), F.col("parents_of"))
    pairs = F.sum(F.col("n_persons") * F.col("n_slots"))
    return reduce(
        DataFrame.unionByName,
        [
            counted(games, games=F.count(F.lit(1)), home_games=F.count_if("is_home")),
            counted(
                shifts,
                shifts=F.count(F.lit(1)),
                parent_assignments=F.coalesce(F.sum(F.when(parents, F.col("n_people"))), F.lit(0)),
                **{
                    f"minutes_{d.duty_type}": F.coalesce(
                        F.sum(F.when((F.col("duty_type") == d.duty_type) & ~parents, length)), F.lit(0)
                    )
                    for d in rules.duties
                },
            ),
            counted(cands, candidates=pairs),
            counted(kept, candidates_after_weekend_rule=pairs),
        ],
    )


def extra_metrics(**tables: DataFrame | None) -> DataFrame:
    """K5: rows per organisation of each named table; missing tables are left out."""
    counted = [
        df.groupBy("org_id").agg(F.count(F.lit(1)).cast("long").alias("value")).select(
            "org_id", F.lit(name).alias("metric"), "value"
        )
        for name, df in tables.items()
        if df is not None
    ]
    return reduce(DataFrame.unionByName, counted)
