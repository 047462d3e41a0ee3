"""Fixture lists, member lists and fixed assignments from delimited text.

Readers turn text lines into a ``value`` column; parsers are plain column
expressions over it and return typed rows plus a table of rejects.  Files are
never rewritten: charset, delimiter and quoting are handled while reading.  The
folder layout ``.../org_id=<n>/...`` supplies the organisation of each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaloom.functions.dates import parse_german, parse_short_german
from rotaloom.functions.intervals import parse_clock
from rotaloom.operators.people import short_name, working_persons
from rotaloom.plans.skew import salted_join
from rotaloom.rules import SUPERVISOR_TEAM, Rules

# First word of the header line, supervisor marker, letter dropped
# from league prefixes, length of the weekday prefix before a short date.
HEADER_WORD = "Nummer"
SUPERVISOR_MARKER = "x"
YOUTH_LETTER = "J"
WEEKDAY_PREFIX = 4

GAME_FIELDS = ["number", "league", "date", "time", "venue", "home", "away", "venue_name"]
PERSON_FIELDS = ["name", "team", "trains", "marker", "hours"]
# Fields in front of the helpers, of which there are ``Rules.helper_columns``.
FIXED_FIELDS = ["date", "from", "to", "duty", "team"]
# A roster this library exported: head count in front of the helpers (Q23).
ROSTER_FIELDS = [*FIXED_FIELDS, "n_people"]


def read_lines(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """Text lines as ``value``, decoded from ``charset``, with the partition columns of the path."""
    lines = spark.read.text(path)
    if charset.upper() != "UTF-8":
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), charset))
    return lines.withColumn("value", F.regexp_replace("value", "[\\r\\x{FEFF}]", "")).filter(F.length("value") > 0)


def _fields(lines: DataFrame, names: list[str], sep: str) -> DataFrame:
    """Split ``value`` with CSV quoting; a line quoted as a whole is unwrapped first."""
    wrapped = F.col("value").rlike('^"[^"]*"$') & F.col("value").contains(sep)
    plain = F.when(wrapped, F.expr("substring(value, 2, length(value) - 2)")).otherwise(F.col("value"))
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = F.from_csv(plain, schema, {"sep": sep, "quote": '"', "mode": "PERMISSIVE"})
    rest = [c for c in lines.columns if c != "value"]
    # The generator keeps later filters from parsing the line again per field.
    return lines.select(*rest, "value", F.explode(F.array(parsed)).alias("f"))


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"f.{name}"), F.lit("")))


def _known(code: Column, rules: Rules) -> Column:
    return code.isin([t.code for t in rules.teams])


def _split(df: DataFrame, good: list, mode: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects; ``failfast`` fails the job at the first reject instead."""
    if mode == "failfast":
        message = F.concat(F.col("reason"), F.lit(": "), F.col("value"))
        checked = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        df = df.filter(checked)
    elif mode != "report":
        raise ValueError(f"unknown mode {mode}")
    rows = df.filter("reason is null").select(*good)
    rejects = df.filter("reason is not null").select("org_id", "value", "reason")
    return rows, rejects


def parse_games(
    lines: DataFrame, clubs: DataFrame, rules: Rules, sep: str = ";", mode: str = "report"
) -> tuple[DataFrame, DataFrame]:
    """S1.  ``clubs`` has one row per organisation: org_id, club, venue."""
    raw = _fields(lines.filter(~F.col("value").rlike(f'^"?{HEADER_WORD}')), GAME_FIELDS, sep)
    own = clubs.select("org_id", "club", F.col("venue").alias("own_venue"))
    raw = salted_join(raw, own, ["org_id"], "left", ["value"], rules.salts)
    home, away, club = _text("home"), _text("away"), F.col("club")
    club_first = home.contains(club)
    own_name = F.when(club_first, home).otherwise(away)
    last = F.substring(own_name, -1, 1)
    number = F.when(F.length(own_name) > F.length(club), last).otherwise("1")
    prefix = F.replace(F.split(_text("league"), "-")[0], F.lit(YOUTH_LETTER), F.lit(""))
    number_text = _text("number")
    typed = raw.select(
        "org_id",
        "value",
        F.when(number_text.rlike(r"^\d{1,18}$"), number_text.try_cast("long"))
        .otherwise(F.xxhash64("org_id", "value"))
        .alias("game_id"),
        parse_german(_text("date")).alias("game_date"),
        parse_clock(_text("time")).alias("start_min"),
        _text("venue").alias("venue"),
        home.alias("home"),
        away.alias("away"),
        F.concat(prefix, number).alias("team_code"),
        (_text("venue") == F.col("own_venue")).alias("is_home"),
        _text("league").alias("league"),
        number.rlike(r"^\d$").alias("_numbered"),
        (club_first | away.contains(club)).alias("_involved"),
    )
    reason = (
        F.when(F.col("game_date").isNull(), "bad date")
        .when(F.col("start_min").isNull(), "bad time")
        .when(F.col("_involved").isNull(), "unknown organisation")
        .when(~F.col("_involved"), "club does not play")
        .when(~F.col("_numbered") | ~_known(F.col("team_code"), rules), "unknown team")
    )
    columns = [
        "org_id", "game_id", "game_date", "start_min", "venue", "home", "away", "team_code", "is_home", "league"
    ]
    return _split(typed.withColumn("reason", reason), columns, mode)


def parse_persons(
    lines: DataFrame, rules: Rules, sep: str = ";", mode: str = "report"
) -> tuple[DataFrame, DataFrame]:
    """S2.  Rows without team and marker are skipped; decimal commas are kept.

    Of equal lines the first counts and the others are rejects, so a member has one key.
    """
    raw = _fields(lines, PERSON_FIELDS, sep)
    supervisor = F.lower(_text("marker")) == SUPERVISOR_MARKER
    team = F.when(supervisor, SUPERVISOR_TEAM).otherwise(F.nullif(_text("team"), F.lit("")))
    trains = F.nullif(_text("trains"), F.lit(""))
    hours = F.replace(_text("hours"), F.lit(","), F.lit(".")).try_cast("double")
    typed = raw.select(
        "org_id",
        "value",
        _text("name").alias("name"),
        short_name(_text("name")).alias("short_name"),
        team.alias("team_code"),
        F.floor(hours * 60 + 0.5).cast("int").alias("worked_min"),
        supervisor.alias("is_supervisor"),
        trains.alias("trains_team"),
    ).filter(F.col("team_code").isNotNull())
    copy = F.row_number().over(Window.partitionBy("org_id", "value").orderBy("name"))
    typed = typed.withColumn("_copy", copy)
    reason = (
        F.when(~_known(F.col("team_code"), rules), "unknown team")
        .when(~_known(F.col("trains_team"), rules), "unknown coached team")
        .when(F.col("worked_min").isNull(), "bad hours")
        .when(F.col("_copy") > 1, "repeated line")
    )
    # Members' keys are never negative, placeholders' always are.
    hashed = F.xxhash64("org_id", "name", "team_code", "trains_team", "value")
    key = hashed.bitwiseAND(F.lit((1 << 63) - 1)).alias("person_id")
    columns = [
        "org_id", key, "name", "short_name", "team_code", "worked_min", "is_supervisor", "trains_team"
    ]
    rows, rejects = _split(typed.withColumn("reason", reason), columns, mode)
    return working_persons(rows, rules), rejects


def parse_fixed(
    lines: DataFrame, rules: Rules, sep: str = ";", mode: str = "report", layout: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """S3.  One line gives one row per named helper; ``layout=ROSTER_FIELDS`` reads an exported roster.

    An end before the start lies after midnight, and so does a start before
    ``night_until_min``: such a shift belongs to the day before.
    """
    helpers = [f"helper{i + 1}" for i in range(rules.helper_columns)]
    raw = _fields(lines, [*(layout or FIXED_FIELDS), *helpers], sep)
    date_text = _text("date")
    long_form = date_text.rlike(r"^\d\d\.\d\d\.\d{4}$")
    day = F.when(long_form, parse_german(date_text)).otherwise(
        parse_short_german(F.expr(f"substring(trim(coalesce(f.date, '')), {WEEKDAY_PREFIX + 1}, 8)"))
    )
    duties = [d.duty_type for d in rules.duties]
    start = parse_clock(_text("from"))
    typed = raw.select(
        "org_id",
        "value",
        day.alias("shift_date"),
        (start + F.when(start < rules.night_until_min, 1440).otherwise(0)).alias("start_min"),
        parse_clock(_text("to")).alias("end_min"),
        _text("duty").alias("duty_type"),
        _text("team").alias("team_code"),
        F.posexplode(F.array(*[_text(h) for h in helpers])).alias("slot_nr", "name"),
    ).filter((F.col("slot_nr") == 0) | (F.col("name") != ""))
    late = F.when(F.col("end_min") < F.col("start_min"), 1440).otherwise(0)
    typed = typed.withColumn("end_min", F.col("end_min") + late)
    reason = (
        F.when(F.col("shift_date").isNull(), "bad date")
        .when(F.col("start_min").isNull() | F.col("end_min").isNull(), "bad time")
        .when(~F.col("duty_type").isin(duties), "unknown duty type")
        .when(~_known(F.col("team_code"), rules), "unknown team")
        .when(F.col("name") == "", "no helper")
    )
    columns = ["org_id", "shift_date", "start_min", "end_min", "duty_type", "team_code", "name", "slot_nr"]
    return _split(typed.withColumn("reason", reason), columns, mode)


def season_window(games: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """Games strictly between the two dates; a missing bound is open."""
    if after is not None:
        games = games.filter(F.col("game_date") > F.lit(after).cast("date"))
    if before is not None:
        games = games.filter(F.col("game_date") < F.lit(before).cast("date"))
    return games


def load_games(spark, path, clubs, rules, charset="ISO-8859-1", sep=";", mode="report", after=None, before=None):
    rows, rejects = parse_games(read_lines(spark, path, charset), clubs, rules, sep, mode)
    return season_window(rows, after, before), rejects


def load_persons(spark, path, rules, charset="UTF-8", sep=";", mode="report"):
    return parse_persons(read_lines(spark, path, charset), rules, sep, mode)


def load_fixed(spark, path, rules, charset="UTF-8", sep=";", mode="report", layout=None):
    return parse_fixed(read_lines(spark, path, charset), rules, sep, mode, layout)

