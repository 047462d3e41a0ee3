"""One season from files to files: load, reject, plan, assign, report, count.

The input folder holds ``games`` and ``persons`` and may hold ``fixed``, each with one
sub-folder ``org_id=<n>`` per organisation.  The output folder gets ``roster`` and
``stats`` as text, and ``assignments``, ``rejects``, ``uncovered`` and ``metrics`` as tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaloom.operators import report
from rotaloom.operators.assign import Assignment
from rotaloom.operators.candidates import readded
from rotaloom.plans.season import Season
from rotaloom.rules import Rules
from rotaloom.sinks import export
from rotaloom.sources import text_files


@dataclass
class Outcome:
    season: Season
    run: Assignment
    rejects: DataFrame
    metrics: DataFrame


def _folder_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def load(
    spark: SparkSession, source: str, clubs: DataFrame, rules: Rules, mode: str = "report", after=None, before=None
) -> tuple[Season, DataFrame]:
    """The season of an input folder and the rejected lines of all its files."""
    games, bad_games = text_files.load_games(spark, f"{source}/games", clubs, rules, mode=mode, after=after, before=before)
    persons, bad_persons = text_files.load_persons(spark, f"{source}/persons", rules, mode=mode)
    rejects = [bad_games.withColumn("file", F.lit("games")), bad_persons.withColumn("file", F.lit("persons"))]
    fixed = None
    if _folder_exists(spark, f"{source}/fixed"):
        fixed, bad_fixed = text_files.load_fixed(spark, f"{source}/fixed", rules, mode=mode)
        rejects.append(bad_fixed.withColumn("file", F.lit("fixed")))
    season = Season(games, persons, rules, fixed)
    if fixed is not None:
        # Lines that parse but name nobody, no shift, or a slot that is taken.
        unresolved = season.fixed_merge[1]
        cells = [F.col(c).cast("string") for c in unresolved.columns if c not in ("org_id", "reason")]
        rejects.append(unresolved.select("org_id", F.concat_ws(";", *cells).alias("value"), "reason", F.lit("fixed").alias("file")))
    return season, reduce(DataFrame.unionByName, rejects)


def run_season(
    spark: SparkSession,
    source: str,
    target: str,
    clubs: DataFrame,
    rules: Rules,
    mode: str = "report",
    on_uncovered: str = "report",
    require_complete: bool = False,
    after: str | None = None,
    before: str | None = None,
) -> Outcome:
    """Plan the season in ``source`` and write everything to ``target``."""
    season, rejects = load(spark, source, clubs, rules, mode, after, before)
    run = season.assign(on_uncovered=on_uncovered, require_complete=require_complete)
    full = season.full(run.roster)
    layout = report.roster_layout(full, season.shifts, season.games, season.people, rules, include_unfilled=True)
    stats = report.stats_lines(
        report.person_stats(full, season.shifts, season.people, season.targets, rules),
        report.team_stats(full, season.shifts, season.people, rules),
        report.idle_stats(full, season.shifts, season.people, season.workers, rules),
    )
    metrics = report.run_metrics(season.games, season.shifts, season.candidates, season.free, rules).unionByName(
        report.extra_metrics(
            fixed=season.fixed_rows,
            readded=readded(season.candidates, season.kickoffs).select("org_id"),
            rejects=rejects,
            assigned=run.roster,
            open_slots=run.uncovered(),
        )
    )
    export.write_roster(layout, f"{target}/roster")
    export.write_stats(stats, f"{target}/stats")
    export.write_table(run.roster, f"{target}/assignments")
    export.write_table(rejects, f"{target}/rejects")
    export.write_table(season.uncovered, f"{target}/uncovered")
    export.write_table(metrics, f"{target}/metrics")
    return Outcome(season, run, rejects, metrics)
