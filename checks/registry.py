"""Registered queries: library operators over the views of the given tables.

Dates leave as ISO text and amounts rounded to three digits, so that results
compare by value across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaloom.functions import dates as D
from rotaloom.functions import intervals as I
from rotaloom.operators import availability, candidates, disjoin, feasible, model, report, score, shifts
from rotaloom.plans.season import Season
from rotaloom.plans.skew import growing
from rotaloom.rules import Rules
from rotaloom.sources import text_files, views

TEAM = Rules()
PLAYER = Rules(team_mode=False)
SHIFT_OUT = [
    "org_id", "shift_id", "shift_date", "start_min", "end_min", "duty_type", "n_people", "parents_of", "past_midnight"
]
CANDIDATE_OUT = [
    "org_id", "shift_id", "shift_date", "start_min", "end_min", "duty_type", "problem", "n_people", "n_slots",
    "minutes", "team_code", "is_supervisor", "coach_of", "n_persons",
]

Query = Callable[[SparkSession, str], DataFrame]


_seasons: dict[tuple, Season] = {}


def forget() -> None:
    """Drop the shared seasons, so that the next query computes its stage tables again."""
    _seasons.clear()


def _season(spark: SparkSession, sf_dir: str, rules: Rules = TEAM, crowded: bool = False, hot: bool = False) -> Season:
    """One season per session, folder and mode; queries share its stage tables."""
    key = (spark.sparkContext.applicationId, sf_dir, rules, crowded, hot)
    if key not in _seasons:
        games = views.games(spark, sf_dir, crowded=crowded, hot=hot)
        _seasons[key] = Season(games, views.persons(spark, sf_dir, hot=hot), rules)
    return _seasons[key]


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as text, null texts as empty texts, amounts rounded."""
    out = []
    for name in columns or df.columns:
        kind = df.schema[name].dataType.simpleString()
        column = F.col(name)
        if kind == "date":
            column = F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit(""))
        elif kind == "string":
            column = F.coalesce(column, F.lit(""))
        elif kind.startswith("decimal"):
            column = F.round(column.cast("double"), 3)
        out.append(column.alias(name))
    return df.select(*out)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 3) for n in names})


def _shift_query(build) -> Query:
    return lambda spark, sf: _plain(build(_season(spark, sf).kickoffs, TEAM), *SHIFT_OUT)


def _from_season(build, rules: Rules = TEAM) -> Query:
    return lambda spark, sf: build(_season(spark, sf, rules))


def _per_shift(cands: DataFrame) -> DataFrame:
    return cands.groupBy("org_id", "shift_id", "problem").agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum(F.col("n_persons") * F.col("n_slots")).alias("n_candidates")
    )


def _readded(season: Season) -> DataFrame:
    return candidates.readded(season.candidates, season.kickoffs)


# -- fixed assignments -------------------------------------------------------
def _named_slots(season: Season) -> DataFrame:
    """The plain roster with names, teams and times."""
    rows = score.filled_slots(season.simple_roster, season.free)
    return rows.join(growing(season.workers.select("org_id", "person_id", "name", "team_code")), ["org_id", "person_id"])


def _fixed_merge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fixed rows from the plain roster; wiping names and cash slots are spoiled on purpose."""
    season = _season(spark, sf_dir, PLAYER)
    duty = F.col("duty_type")
    fixed = _named_slots(season).select(
        "org_id", "shift_date", "start_min", "end_min", "duty_type", "team_code",
        F.when(duty == "Wischen", "Nobody").otherwise(F.col("name")).alias("name"),
        (F.col("slot_nr") + F.when(duty == "Kasse", 1).otherwise(0)).alias("slot_nr"),
    )
    return candidates.merge_fixed(fixed, season.candidates, season.workers, PLAYER)


# -- model and scores --------------------------------------------------------
def _score(season: Season) -> DataFrame:
    scored = score.score(season.simple_roster, season.active, season.free, season.costs, season.rules)
    return _plain(scored, "org_id", "problem", "n_workers", "n_filled", "balance_cost", "proximity_cost", "objective")


def _time_balance(season: Season) -> DataFrame:
    choices = season.free.groupBy(*candidates.CLASS).agg(
        F.sum("n_slots").alias("n_choices"), F.sum(F.col("n_slots") * F.col("minutes")).alias("choice_minutes")
    )
    return _plain(
        season.active.join(growing(choices), candidates.CLASS),
        "org_id", "problem", "person_id", "n_choices", "choice_minutes", "owing_min",
    )


def _same_team(season: Season) -> DataFrame:
    return (
        season.free.filter("n_slots > 1 and problem = 'KVW'")
        .groupBy("org_id", "shift_id", "team_code")
        .agg(F.sum("n_persons").alias("n_persons"), F.sum(F.col("n_persons") * F.col("n_slots")).alias("n_rows"))
        .filter("n_persons > 1")
    )


def _disjoint(season: Season) -> DataFrame:
    keys = ["org_id", "problem", "team_code", "shift_date"]
    spans = season.candidates.select(*keys, "start_min", "end_min").distinct()
    pieces = disjoin.disjoin(spans, keys).groupBy(*keys, "piece_start", "piece_end")
    return _plain(pieces.agg(F.count(F.lit(1)).alias("n_covering")))


def _violations(season: Season) -> DataFrame:
    found = score.violations(season.simple_roster, season.active, season.free, season.rules)
    return found.groupBy("org_id", "rule").agg(
        F.count(F.lit(1)).alias("n_findings"), F.sum("activity").alias("total_activity")
    )


def _violations_spoiled(season: Season) -> DataFrame:
    """The plain roster with rows missing, doubled, for unknown persons and for slots that do not exist."""
    rows, person = season.simple_roster, F.col("person_id")
    gone = person % 11 == 2
    spoiled = (
        rows.filter(~gone)
        .withColumn("person_id", F.when(person % 5 == 0, 999_999_999).otherwise(person))
        .unionByName(rows.filter(person % 7 == 1).withColumn("slot_nr", F.col("slot_nr") + 100))
        .unionByName(rows.filter(person % 13 == 3))
    )
    found = score.violations(spoiled, season.active, season.free, season.rules, rows.filter(gone))
    return (
        found.filter("rule not in ('N2', 'N3')")
        .groupBy("org_id", "rule")
        .agg(F.count(F.lit(1)).alias("n_findings"), F.sum("activity").alias("total_activity"))
    )


def _fixed_roster_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assigner run around fixed slots, those of the plain roster that start on the hour."""
    base = _season(spark, sf_dir)
    fixed = _named_slots(base).filter("start_min % 60 = 0").select(
        "org_id", "shift_date", "start_min", "end_min", "duty_type", "team_code", "name", "slot_nr"
    )
    season = Season(base.games, base.persons, base.rules, fixed)
    run = season.assign()
    keys = ["org_id", "problem"]
    placed = run.roster.filter("is_fixed").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fixed"))
    rejects = season.fixed_merge[1].groupBy("org_id").agg(F.count(F.lit(1)).alias("n_rejects"))
    broken = season.violations(run.roster).groupBy("org_id").agg(F.count(F.lit(1)).alias("n_violations"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_fixed", "n_rejects", "n_violations")]
    return (
        run.status().join(placed, keys, "left").join(rejects, "org_id", "left").join(broken, "org_id", "left")
        .select(*keys, "n_slots", "n_filled", "status", *counts)
    )


def _season_totals(season: Season) -> DataFrame:
    """The reports of an assigned roster, added up: lines with a shift, planned minutes, persons with and without duty."""
    full = season.full(season.assign().roster)
    layout = report.roster_layout(full, season.shifts, season.games, season.people, season.rules)
    stats = report.person_stats(full, season.shifts, season.people, season.targets, season.rules)
    idle = report.idle_stats(full, season.shifts, season.people, season.workers, season.rules)
    lines = layout.filter("duty_type is not null").groupBy("org_id").agg(F.count(F.lit(1)).alias("n_shift_lines"))
    busy = stats.groupBy("org_id").agg(F.sum("planned_min").alias("planned_min"), F.count(F.lit(1)).alias("_busy"))
    rest = idle.groupBy("org_id").agg(F.count(F.lit(1)).alias("_idle"))
    people = (F.col("_busy") + F.coalesce("_idle", F.lit(0))).alias("n_people")
    return lines.join(busy, "org_id").join(rest, "org_id", "left").select("org_id", "n_shift_lines", "planned_min", people)


def _model_size(season: Season) -> DataFrame:
    """Size of the model counted on classes, without listing single persons."""
    keys = ["org_id", "problem"]
    choices = season.free.groupBy(*keys).agg(F.sum(F.col("n_persons") * F.col("n_slots")).alias("n_choices"))
    slots = candidates.open_slots(season.free).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_slot_rows"))
    workers = season.active.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_workers"))
    return choices.join(slots, keys).join(workers, keys)


def _team_model(season: Season, kept=None):
    """Model of both problems; one representative stands behind each class.  ``kept`` thins out the roster."""
    pairs = season.pairs
    built = model.build_model(pairs, season.active, season.rules)
    roster = season.simple_roster if kept is None else season.simple_roster.filter(kept)
    return built, model.solution_of(roster, built, pairs, season.active)


def _model_objective(season: Season) -> DataFrame:
    return _rounded(model.objective(*_team_model(season)), "objective")


def _model_row_kinds(season: Season) -> DataFrame:
    built, _ = _team_model(season)
    kind = F.split("row", "/")[0].alias("kind")
    rows = built.rows.groupBy("org_id", kind).agg(F.count(F.lit(1)).alias("n_rows"))
    coefs = built.coefs.groupBy("org_id", kind).agg(F.count(F.lit(1)).alias("n_coefs"))
    return rows.join(coefs, ["org_id", "kind"])


def _model_broken_rows(season: Season) -> DataFrame:
    # A third of the representatives do not turn up.
    broken = model.broken_rows(*_team_model(season, F.pmod("person_id", F.lit(3)) != 1))
    return broken.select("org_id", "problem", "row", F.col("activity").cast("long").alias("activity"))


def _model_broken_sets(season: Season) -> DataFrame:
    # Sets of type 2, and every third representative stands in all slots that they may take.
    pairs = season.pairs
    built = model.build_model(pairs, season.active, season.rules)
    wide = replace(built, sets=built.sets.withColumn("max_nonzero", F.lit(2)))
    value = F.when(F.pmod("person_id", F.lit(3)) == 1, 1.0).otherwise(0.0)
    solution = pairs.select("org_id", "problem", model.choice_name().alias("var"), value.alias("value"))
    return model.broken_sets(wide, solution).drop("max_nonzero")


def _impossible(season: Season) -> DataFrame:
    # Only members with an even number come, so that some days cannot be filled.
    few = season.workers.filter(F.pmod("person_id", F.lit(16)) == 0)
    present = candidates.worker_classes(few)
    free = season.free.drop("n_persons").join(growing(present), candidates.CLASS)
    found = feasible.impossible_moments(free)
    return _plain(found, "org_id", "shift_date", "at_min", "n_needed", "n_members").withColumn("n_missing", F.col("n_needed") - F.col("n_members"))


def _checked_assignment(season: Season, compare: bool) -> DataFrame:
    """Status, rule check and bounds of an assigner run, one row per organisation and problem."""
    keys = ["org_id", "problem"]
    run = season.assign()
    rules = season.rules
    scored = score.score(run.roster, run.workers, season.free, season.costs, rules)
    bound = score.lower_bound(run.workers, season.free, season.costs, rules)
    broken = (
        score.violations(run.roster, run.workers, season.free, rules)
        .filter("rule <> 'N1'")
        .groupBy("org_id")
        .agg(F.count(F.lit(1)).alias("n_violations"))
    )
    out = (
        run.status()
        .join(scored.drop("n_filled"), keys)
        .join(bound, keys)
        .join(broken, "org_id", "left")
        .withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))
        .withColumn("above_bound", F.col("objective") >= F.col("lower_bound"))
    )
    if not compare:
        return out.select(*keys, "n_slots", "n_violations", "above_bound")
    simple = score.score(season.simple_roster, run.workers, season.free, season.costs, rules)
    return out.join(simple.select(*keys, F.col("objective").alias("simple")), keys).select(
        *keys, "n_slots", "n_filled", "n_violations", "status", "above_bound",
        (F.col("objective") <= F.col("simple")).alias("beats_simple_roster"),
    )


# -- reports -----------------------------------------------------------------
def _person_stats(season: Season) -> DataFrame:
    full = season.full(season.simple_roster)
    stats = report.person_stats(full, season.shifts, season.people, season.targets, season.rules)
    return _rounded(stats, "target_min", "off_target", "off_mean")


def _team_stats(season: Season) -> DataFrame:
    full = season.full(season.simple_roster)
    return _rounded(report.team_stats(full, season.shifts, season.people, season.rules), "mean_min")


def _idle_stats(season: Season) -> DataFrame:
    full = season.full(season.simple_roster)
    idle = report.idle_stats(full, season.shifts, season.people, season.workers, season.rules)
    return _rounded(idle, "off_mean")


def _layout(season: Season) -> DataFrame:
    full = season.full(season.simple_roster)
    layout = report.roster_layout(full, season.shifts, season.games, season.people, season.rules)
    return _plain(layout, "org_id", "shift_date", "row_nr", "line")


# -- text ingest -------------------------------------------------------------
def _game_lines(games: DataFrame) -> DataFrame:
    cells = [
        F.col("game_id").cast("string"), F.col("league"), D.format_german(F.col("game_date")),
        I.clock(F.col("start_min")), F.col("venue"), F.concat(F.lit('"'), F.col("home"), F.lit('"')),
        F.col("away"), F.lit("Hall"),
    ]
    return games.select("org_id", F.concat_ws(";", *cells).alias("value"))


def _parsed_games(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _game_lines(views.games(spark, sf_dir))
    return text_files.parse_games(lines, views.clubs(spark, sf_dir), TEAM)


def _person_lines(persons: DataFrame) -> DataFrame:
    minutes = F.col("worked_min")
    hours = F.regexp_replace(F.format_string("%.6f", minutes / 60.0), "\\.", ",")
    supervisor = F.col("is_supervisor")
    cells = F.concat_ws(
        ";",
        "name",
        F.when(supervisor, "").otherwise(F.col("team_code")),
        F.coalesce("trains_team", F.lit("")),
        F.when(supervisor, "X").otherwise(""),
        hours,
    )
    # Every line of a supervisor is quoted as a whole.
    value = F.when(supervisor, F.concat(F.lit('"'), cells, F.lit('"'))).otherwise(cells)
    return persons.select("org_id", value.alias("value"))


def _parsed_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = text_files.parse_persons(_person_lines(views.persons(spark, sf_dir)), TEAM)
    return _plain(rows.drop("person_id"))


def _person_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some members in an unknown team, some coaching one, some without hours, and some lines twice."""
    digit = F.pmod("person_id", F.lit(10))
    persons = views.persons(spark, sf_dir)
    damaged = (
        persons.withColumn("team_code", F.when(digit == 3, "ZZ9").otherwise(F.col("team_code")))
        .withColumn("trains_team", F.when(digit == 4, "ZZ9").otherwise(F.col("trains_team")))
        .withColumn("worked_min", F.when(digit != 5, F.col("worked_min")))
    )
    lines = _person_lines(damaged.unionByName(damaged.filter(digit == 7)))
    _, rejects = text_files.parse_persons(lines, TEAM)
    return rejects.groupBy("org_id", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def _parsed_fixed(season: Season) -> DataFrame:
    cells = F.concat_ws(
        ";",
        F.concat(F.lit("Sa, "), F.date_format("shift_date", "dd.MM.yy")),
        I.clock(F.col("start_min")), I.clock(F.col("end_min")), "duty_type", "team_code", "name", "second",
    )
    named = _named_slots(season)
    shift = ["org_id", "shift_id", "shift_date", "start_min", "end_min", "duty_type", "team_code"]
    lines = (
        named.groupBy(*shift)
        .agg(
            F.max(F.when(F.col("slot_nr") == 0, F.col("name"))).alias("name"),
            F.max(F.when(F.col("slot_nr") == 1, F.col("name"))).alias("second"),
        )
        .select("org_id", cells.alias("value"))
    )
    rows, _ = text_files.parse_fixed(lines, season.rules)
    return _plain(rows)


# -- scalar packs ------------------------------------------------------------
def _date_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    base = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("d"),
        ((key * 7) % 61 - 30).cast("int").alias("e_off"),
        ((key * 5) % 41 - 20).cast("int").alias("n"),
    )
    base = base.withColumn("e", F.date_add("d", F.col("e_off")))
    d, e, n = F.col("d"), F.col("e"), F.col("n")
    back = (
        (D.parse_german(D.format_german(d)) == d)
        & (D.parse_iso(F.date_format(d, "yyyy-MM-dd")) == d)
        & (D.parse_basic_iso(D.format_basic_iso(d)) == d)
        & (D.parse_short_german(F.lit("12.05.18")) == F.lit("2018-05-12").cast("date"))
    )
    out = base.select(
        "o_orderkey",
        d.alias("day"),
        D.is_saturday(d).alias("is_saturday"),
        D.is_sunday(d).alias("is_sunday"),
        D.weekend_key(d).alias("weekend_key"),
        D.before(d, e).alias("is_before"),
        D.before_or_equal(d, e).alias("is_before_or_equal"),
        D.after(d, e).alias("is_after"),
        D.after_or_equal(d, e).alias("is_after_or_equal"),
        D.earlier(d, e).alias("earlier"),
        D.later(d, e).alias("later"),
        D.format_german(d).alias("german"),
        D.format_basic_iso(d).alias("basic_iso"),
        D.format_month(d).alias("month_text"),
        D.int_day(d).alias("int_day"),
        D.int_month(d).alias("int_month"),
        back.alias("parses_back"),
        D.add_days(d, n).alias("added_days"),
        D.add_months(d, n).alias("added_months"),
        D.first_of_month(d).alias("first_of_month"),
        D.middle_of_month(d).alias("middle_of_month"),
        D.last_of_month(d).alias("last_of_month"),
        D.first_of_year(d).alias("first_of_year"),
        D.first_of_week(d).alias("first_of_week"),
        D.weekday_of_week(d, 4).alias("thursday"),
        D.month_length(d).alias("month_length"),
        D.days_between(d, e).alias("days_between"),
        D.month_changes(d, e).alias("month_changes"),
        D.weekday_count(d, e).alias("weekday_count"),
        D.add_workdays(d, n).alias("workday"),
    )
    return _plain(out)


def _interval_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = views.games(spark, sf_dir)
    key = F.col("game_id")
    other_start = (600 + 15 * ((key * 3) % 41)).cast("int")
    a = I.span("start_min", F.col("start_min") + 90)
    b = I.span(other_start, (other_start + 15 * (key % 9)).cast("int"))
    hull, stretched = I.hull(a, b), I.stretch(a, b.start)
    blocked = I.blocked_window(F.col("start_min"), F.col("is_home"), TEAM)
    return games.select(
        "org_id",
        "game_id",
        hull.start.alias("hull_start"),
        hull.end.alias("hull_end"),
        stretched.start.alias("stretch_start"),
        stretched.end.alias("stretch_end"),
        I.duration(b).alias("duration"),
        I.is_empty(b).alias("is_empty"),
        I.contains_point(a, b.start).alias("contains_point"),
        I.contains(a, b).alias("contains_span"),
        I.intersects(a, b).alias("intersects"),
        I.point_distance(a, b.start).alias("point_distance"),
        I.span_distance(a, b).alias("span_distance"),
        blocked.start.alias("block_from"),
        blocked.end.alias("block_to"),
        I.clock(F.col("start_min")).alias("clock"),
    )


def queries() -> dict[str, Query]:
    person_out = ["org_id", "person_id", "name", "team_code", "worked_min", "is_supervisor", "trains_team"]
    target_out = ["org_id", "team_code", "n_persons", "worked_min", "target_min"]
    season = _from_season
    return {
        "day_envelope": season(lambda x: _plain(shifts.day_envelope(x.kickoffs, x.rules))),
        "supervision_shifts": _shift_query(shifts.supervision_shifts),
        "parent_shifts": _shift_query(shifts.parent_shifts),
        "player_sales_shifts": _shift_query(shifts.player_sales_shifts),
        "cash_shifts": _shift_query(shifts.cash_shifts),
        "wiper_shifts": _shift_query(shifts.wiper_shifts),
        "all_shifts": _shift_query(shifts.all_shifts),
        "shift_rejects": season(lambda x: _plain(shifts.shift_rejects(x.kickoffs, x.rules))),
        "wiper_conflicts": season(lambda x: _plain(shifts.wiper_conflicts(x.kickoffs, x.rules))),
        "team_blocks": season(lambda x: _plain(availability.team_blocks(x.kickoffs, x.persons, x.rules))),
        "coach_blocks": season(lambda x: _plain(availability.coach_blocks(x.kickoffs, x.persons, x.rules))),
        "headcounts": season(lambda x: x.headcounts),
        "representatives": season(lambda x: _plain(x.workers, *person_out)),
        "persons_under_target": season(lambda x: _plain(x.workers, *person_out), PLAYER),
        "planned_minutes": season(lambda x: x.planned),
        "target_minutes": season(lambda x: x.targets.select(*target_out)),
        "target_minutes_per_head": season(lambda x: x.targets.select(*target_out), PLAYER),
        "candidates_team_mode": season(lambda x: _plain(x.candidates, *CANDIDATE_OUT)),
        "candidates_player_mode": season(lambda x: _per_shift(x.candidates), PLAYER),
        "weekend_filtered": season(
            lambda x: _plain(candidates.weekend_filtered(x.candidates, x.kickoffs), *CANDIDATE_OUT)
        ),
        "weekend_filtered_player_mode": season(
            lambda x: _per_shift(candidates.weekend_filtered(x.candidates, x.kickoffs)), PLAYER
        ),
        "readded": lambda s, d: _plain(_readded(_season(s, d, TEAM, crowded=True)), *CANDIDATE_OUT),
        "readded_player_mode": lambda s, d: _per_shift(_readded(_season(s, d, PLAYER, crowded=True))),
        "free_candidates": season(lambda x: _plain(x.free, *CANDIDATE_OUT, "cost")),
        "uncovered_shifts": season(lambda x: _plain(x.uncovered, *SHIFT_OUT)),
        "parent_assignments": season(lambda x: candidates.parent_assignments(x.shifts, x.rules)),
        "fixed_merge": lambda s, d: _fixed_merge(s, d)[0],
        "fixed_rejects": lambda s, d: _plain(_fixed_merge(s, d)[1]),
        "proximity_cost": season(lambda x: x.costs),
        "time_balance_rows": season(_time_balance, PLAYER),
        "same_team_rows": season(_same_team, PLAYER),
        "disjoint_intervals": season(_disjoint, PLAYER),
        "simple_roster": season(lambda x: x.simple_roster),
        "score_roster": season(_score),
        "score_roster_player_mode": season(_score, PLAYER),
        "roster_violations": season(_violations, PLAYER),
        "roster_violations_spoiled": season(_violations_spoiled, PLAYER),
        "fixed_roster_status": _fixed_roster_status,
        "season_totals": season(_season_totals),
        "model_size": season(_model_size, PLAYER),
        "model_objective": season(_model_objective),
        "model_row_kinds": season(_model_row_kinds),
        "model_broken_rows": season(_model_broken_rows),
        "model_broken_sets": season(_model_broken_sets),
        "impossible_moments": season(_impossible, PLAYER),
        "assigner_summary": season(lambda x: _checked_assignment(x, True)),
        "candidates_hot_org": lambda s, d: _per_shift(_season(s, d, PLAYER, hot=True).candidates),
        "stats_person_hot_org": lambda s, d: _person_stats(_season(s, d, PLAYER, hot=True)),
        "assigner_hot_org": lambda s, d: _checked_assignment(_season(s, d, TEAM, hot=True), True),
        "assigner_player_mode": season(lambda x: _checked_assignment(x, False), PLAYER),
        "stats_person": season(_person_stats),
        "stats_person_player_mode": season(_person_stats, PLAYER),
        "stats_team": season(_team_stats),
        "stats_idle": season(_idle_stats),
        "stats_idle_player_mode": season(_idle_stats, PLAYER),
        "roster_layout": season(_layout),
        "run_metrics": season(
            lambda x: report.run_metrics(x.games, x.shifts, x.candidates, x.free, x.rules), PLAYER
        ),
        "ingest_games": lambda s, d: _plain(_parsed_games(s, d)[0]),
        "ingest_rejects": lambda s, d: _parsed_games(s, d)[1]
        .groupBy("org_id", "reason")
        .agg(F.count(F.lit(1)).alias("n_rows")),
        "ingest_persons": _parsed_persons,
        "ingest_person_rejects": _person_rejects,
        "ingest_fixed": season(_parsed_fixed, PLAYER),
        "season_window": lambda s, d: _plain(
            text_files.season_window(views.games(s, d), "2000-09-01", "2001-06-30"), "org_id", "game_id", "game_date"
        ),
        "date_pack": _date_pack,
        "interval_pack": _interval_pack,
    }
