"""Duty shifts of home-game days.

The game table is read once and reduced to *kick-offs*: one row per team, day,
side and minute.  The reduction is a plain hash aggregation with map-side
partial results, so copies and crowded days shrink before they are shuffled,
and kick-offs per organisation and day are bounded by teams times minutes.
Everything that plans duties works on kick-offs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.functions.intervals import Span, pad
from rotaloom.rules import CASH, SALES, SUPERVISION, WIPING, Rules

DAY = ["org_id", "shift_date"]
SHIFT_COLUMNS = [
    "org_id",
    "shift_id",
    "shift_date",
    "start_min",
    "end_min",
    "duty_type",
    "n_people",
    "parents_of",
    "past_midnight",
]


def kickoffs(games: DataFrame) -> DataFrame:
    """Games per organisation, day, team, side and minute, with the smallest and largest key."""
    return games.groupBy(
        "org_id", F.col("game_date").alias("shift_date"), "team_code", "is_home", "start_min"
    ).agg(
        F.count(F.lit(1)).alias("n_games"), F.min("game_id").alias("first_id"), F.max("game_id").alias("last_id")
    )


def home_kickoffs(kicks: DataFrame) -> DataFrame:
    """P1."""
    return kicks.filter("is_home")


def is_parent_sales(duty_type: Column, parents_of: Column) -> Column:
    return (duty_type == SALES) & parents_of.isNotNull()


def day_facts(kicks: DataFrame, rules: Rules) -> DataFrame:
    """One row per organisation and home day with every number A1, A3, A4 and A5 need."""
    start = F.col("start_min")
    parent = rules.has_flag(F.col("team_code"), "parent_duty")
    cash = rules.has_flag(F.col("team_code"), "has_cash")
    early = F.col("team_code") == rules.early_team
    return (
        home_kickoffs(kicks)
        .groupBy(*DAY)
        .agg(
            F.min(start).alias("first_start"),
            F.max(start).alias("last_start"),
            F.min_by("team_code", F.struct("start_min", "first_id")).alias("first_team"),
            F.max(F.when(parent, start)).alias("last_parent_start"),
            F.min(F.when(~parent, start)).alias("first_player_start"),
            F.max(F.when(~parent, start)).alias("last_player_start"),
            F.coalesce(F.sum(F.when(cash, F.col("n_games"))), F.lit(0)).alias("n_cash"),
            F.min(F.when(cash, start)).alias("first_cash_start"),
            F.max(F.when(cash, start)).alias("last_cash_start"),
            F.min(F.when(cash & early, start)).alias("first_early_cash_start"),
        )
    )


def day_envelope(kicks: DataFrame, rules: Rules) -> DataFrame:
    """A1: first to last kick-off, 30 minutes earlier if the early team opens the day."""
    return _envelope(day_facts(kicks, rules), rules).select(
        *DAY, F.col("range_start").alias("start_min"), F.col("range_end").alias("end_min")
    )


def _envelope(facts: DataFrame, rules: Rules) -> DataFrame:
    lead = F.when(F.col("first_team") == rules.early_team, rules.early_min).otherwise(0)
    return facts.select(
        "*", (F.col("first_start") - lead).alias("range_start"), F.col("last_start").alias("range_end")
    )


def _padded(duty_type: str, window: Span, rules: Rules) -> Column:
    duty = rules.duty(duty_type)
    padded = pad(window, duty.lead_min, duty.run_out_min)
    return F.struct(
        F.lit(duty_type).alias("duty_type"),
        padded.start.cast("int").alias("range_start"),
        padded.end.cast("int").alias("range_end"),
    )


def supervision_range(rules: Rules) -> Column:
    """A4 from the day facts plus the envelope columns."""
    return _padded(SUPERVISION, Span(F.col("range_start"), F.col("range_end")), rules)


def player_sales_range(rules: Rules) -> Column:
    """A3: players sell from the end of the parents' chain, else around their own first game."""
    lead = rules.duty(SALES).lead_min
    parents_end = F.col("last_parent_start") + rules.parent_run_out_min
    begin = F.coalesce(parents_end + lead, F.col("first_player_start"))
    window = Span(begin, F.col("last_player_start"))
    return F.when(F.col("last_player_start").isNotNull(), _padded(SALES, window, rules))


def cash_range(rules: Rules) -> Column:
    """A5: cash games of the day; an early-team game opening them counts 30 minutes earlier."""
    opens_early = F.col("first_early_cash_start") == F.col("first_cash_start")
    shifted = F.col("first_cash_start") - rules.early_min
    begin = F.when(opens_early, shifted).otherwise(F.col("first_cash_start"))
    end = F.when(opens_early & (F.col("n_cash") == 1), shifted).otherwise(F.col("last_cash_start"))
    return F.when(F.col("n_cash") > 0, _padded(CASH, Span(begin, end), rules))


def duty_ranges(kicks: DataFrame, rules: Rules, duty_types: tuple[str, ...] = (SUPERVISION, SALES, CASH)) -> DataFrame:
    """Padded ranges still to be cut into shifts, one row per day and duty type."""
    makers = {SUPERVISION: supervision_range, SALES: player_sales_range, CASH: cash_range}
    structs = F.array(*[makers[d](rules) for d in duty_types])
    return (
        _envelope(day_facts(kicks, rules), rules)
        .select(*DAY, F.explode(structs).alias("r"))
        .filter("r is not null")
        .select(*DAY, "r.duty_type", "r.range_start", "r.range_end")
    )


def best_length(total_hh: Column, lengths: Column) -> Column:
    """Length (half-hours) whose whole multiples lose least of the range; first one wins."""

    def rated(length: Column, position: Column) -> Column:
        times = total_hh / length.cast("double")
        loss = F.abs(times - F.floor(times + 0.5))
        return F.struct(loss.alias("loss"), position.alias("position"), length.alias("length"))

    return F.least(total_hh, F.array_min(F.transform(lengths, rated))["length"])


def cut_plan(ranges: DataFrame, rules: Rules) -> DataFrame:
    """Length, number and validity of the shifts of each range (A7 and the bounds of A8)."""
    s, e = F.col("range_start"), F.col("range_end")
    total = (F.floor(e / 30) - F.floor(s / 30)).cast("int")
    lengths = rules.duty_value(F.col("duty_type"), "lengths_hh")
    step = F.col("step_min")
    n = F.col("n_raw")
    tail = F.when(n == 1, step).otherwise(e - s - step * (n - 1))
    short_tail = F.col("tail_min") < rules.min_shift_min
    return (
        ranges.withColumn("step_min", (30 * best_length(total, lengths)).cast("int"))
        .withColumn("n_raw", F.when(step > 0, F.greatest(F.lit(1), F.ceil((e - s) / step).cast("int"))))
        .withColumn("tail_min", tail)
        .withColumn(
            "reason",
            F.when(step <= 0, "empty range").when((n == 1) & short_tail, "range shorter than one shift"),
        )
        .withColumn("merged", (n > 1) & short_tail)
    )


def cut_ranges(ranges: DataFrame, rules: Rules) -> DataFrame:
    """Consecutive shifts of one length; a short last one joins its predecessor."""
    s, e, step, k = (F.col(c) for c in ("range_start", "range_end", "step_min", "k"))
    last = F.col("n_raw") - 1 - F.col("merged").cast("int")
    begin = s + step * k
    end = F.when(k == 0, s + step).otherwise(F.least(s + step * (k + 1), e))
    end = F.when(F.col("merged") & (k == last), e).otherwise(end)
    cut = (
        cut_plan(ranges, rules)
        .filter("reason is null")
        .select("*", F.explode(F.sequence(F.lit(0), last)).alias("k"))
        .select(*DAY, begin.alias("start_min"), end.alias("end_min"), "duty_type")
    )
    return finish_shifts(cut.withColumn("parents_of", F.lit(None).cast("string")), rules)


def shift_rejects(kicks: DataFrame, rules: Rules) -> DataFrame:
    """Ranges that yield no shift, with the reason."""
    return cut_plan(duty_ranges(kicks, rules), rules).filter("reason is not null").select(
        *DAY, "duty_type", "range_start", "range_end", "reason"
    )


def finish_shifts(shifts: DataFrame, rules: Rules) -> DataFrame:
    """Add the value-based shift key, head count and the past-midnight flag."""
    short = rules.duty_value(F.col("duty_type"), "short")
    shift_id = F.concat_ws(
        "/",
        F.date_format("shift_date", "yyyy-MM-dd"),
        short,
        F.concat_ws("-", F.col("start_min").cast("string"), F.col("end_min").cast("string")),
        F.col("parents_of"),
    )
    return shifts.select(
        "org_id",
        shift_id.alias("shift_id"),
        "shift_date",
        F.col("start_min").cast("int").alias("start_min"),
        F.col("end_min").cast("int").alias("end_min"),
        "duty_type",
        rules.duty_value(F.col("duty_type"), "n_people").alias("n_people"),
        "parents_of",
        (F.col("end_min") > 1440).alias("past_midnight"),
    )


def parent_shifts(kicks: DataFrame, rules: Rules) -> DataFrame:
    """A2: chained sales shifts of the parents; the last home game of a team per day counts.

    The day windows run over kick-offs, so their size is bounded by the minutes
    of a day and not by the number of games.
    """
    start = F.col("start_min")
    slots = home_kickoffs(kicks).filter(rules.has_flag(F.col("team_code"), "parent_duty"))
    in_day = Window.partitionBy(*DAY)
    in_order = in_day.orderBy("start_min", "last_id")
    team_day = Window.partitionBy(*DAY, "team_code")
    opening = F.min(F.struct("start_min", "first_id")).over(in_day)
    chain = slots.select(
        "*",
        F.lead("start_min").over(in_order).alias("next_start"),
        (F.struct(start, F.col("last_id").alias("first_id")) == opening).alias("opens_day"),
        F.max("start_min").over(team_day).alias("team_last_start"),
    ).filter("start_min = team_last_start")
    begin = start - F.when(F.col("opens_day"), rules.parent_lead_min).otherwise(rules.parent_handover_min)
    end = F.coalesce(F.col("next_start") - rules.parent_handover_min, start + rules.parent_run_out_min)
    return finish_shifts(
        chain.select(
            *DAY,
            begin.alias("start_min"),
            end.alias("end_min"),
            F.lit(SALES).alias("duty_type"),
            F.col("team_code").alias("parents_of"),
        ),
        rules,
    )


def wiper_shifts(kicks: DataFrame, rules: Rules) -> DataFrame:
    """One padded hour from the kick-off of each home game that needs wipers."""
    duty = rules.duty(WIPING)
    start = F.col("start_min")
    window = pad(Span(start, start + rules.wiper_min), duty.lead_min, duty.run_out_min)
    return finish_shifts(
        home_kickoffs(kicks)
        .filter(rules.has_flag(F.col("team_code"), "has_wiper"))
        .select(*DAY, window.start.alias("start_min"), window.end.alias("end_min"))
        .distinct()
        .withColumn("duty_type", F.lit(WIPING))
        .withColumn("parents_of", F.lit(None).cast("string")),
        rules,
    )


def wiper_conflicts(kicks: DataFrame, rules: Rules) -> DataFrame:
    """Audit of days with more than one game that needs wipers."""
    return (
        home_kickoffs(kicks)
        .filter(rules.has_flag(F.col("team_code"), "has_wiper"))
        .groupBy(*DAY)
        .agg(F.sum("n_games").alias("n_games"))
        .filter("n_games > 1")
    )


def supervision_shifts(kicks: DataFrame, rules: Rules) -> DataFrame:
    return cut_ranges(duty_ranges(kicks, rules, (SUPERVISION,)), rules)


def player_sales_shifts(kicks: DataFrame, rules: Rules) -> DataFrame:
    return cut_ranges(duty_ranges(kicks, rules, (SALES,)), rules)


def cash_shifts(kicks: DataFrame, rules: Rules) -> DataFrame:
    return cut_ranges(duty_ranges(kicks, rules, (CASH,)), rules)


def all_shifts(kicks: DataFrame, rules: Rules) -> DataFrame:
    """Every shift of every home day."""
    return (
        cut_ranges(duty_ranges(kicks, rules), rules)
        .unionByName(parent_shifts(kicks, rules))
        .unionByName(wiper_shifts(kicks, rules))
    )
