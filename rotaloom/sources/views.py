"""Games and persons derived from the order and customer tables.

Organisations, fixtures and members are read off existing columns, so the
operators can be exercised and checked on any scale of those tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaloom.plans.skew import growing
from rotaloom.rules import SUPERVISOR_TEAM, Rules

DEFAULT_RULES = Rules()
MEMBERS_PER_ORG = 150
CLUB_PREFIX = "SC Example "
VISITOR = "TV Other"


def _team_code(index: Column, rules: Rules) -> Column:
    return F.get(F.array(*[F.lit(t.code) for t in rules.teams]), index)


def _org(customer: Column, hot: bool) -> Column:
    """Organisation of a customer; with ``hot`` the first one has a third of all."""
    org = F.floor(customer / MEMBERS_PER_ORG).cast("int")
    return F.when(customer % 3 == 0, 0).otherwise(org) if hot else org


def games(
    spark: SparkSession, sf_dir: str, rules: Rules = DEFAULT_RULES, crowded: bool = False, hot: bool = False
) -> DataFrame:
    """Games read off the orders.  ``crowded`` adds away games of every team on the other
    day of some weekends, so that the weekend rule leaves shifts without candidates."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    key = F.col("o_orderkey")
    week = 7 * F.pmod(key * 11, F.lit(161))
    day = F.when(key % 5 == 0, (key * 3) % 7).otherwise(5 + key % 2)
    code = F.col("team_code")
    number = F.regexp_extract(code, r"(\d)$", 1)
    prefix = F.regexp_replace(F.regexp_replace(code, r"\d$", ""), "^([mwg])", "$1J")
    club = F.concat(F.lit(CLUB_PREFIX), F.col("org_id").cast("string"))
    own_side = F.when(number > "1", F.concat(club, F.lit(" "), number)).otherwise(club)
    base = orders.join(growing(customers), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(
        _org(F.col("o_custkey"), hot).alias("org_id"),
        key.alias("game_id"),
        F.date_add(F.lit("2000-01-03").cast("date"), (week + day).cast("int")).alias("game_date"),
        (600 + 15 * ((key * 7) % 41)).cast("int").alias("start_min"),
        (F.col("o_orderstatus") != "F").alias("is_home"),
        _team_code(((key * 13) % 31).cast("int"), rules).alias("team_code"),
    )
    if crowded:
        weekday = F.weekday("game_date")
        away = base.filter((F.col("game_id") % 40 == 0) & (weekday >= 5)).select(
            "org_id",
            "game_id",
            F.date_add("game_date", F.when(weekday == 5, 1).otherwise(-1)).alias("game_date"),
            F.explode(F.sequence(F.lit(0), F.lit(30))).alias("_t"),
        )
        base = base.unionByName(
            away.select(
                "org_id",
                (F.col("game_id") * 100 + F.col("_t") + 1_000_000_000).alias("game_id"),
                "game_date",
                F.lit(600).alias("start_min"),
                F.lit(False).alias("is_home"),
                _team_code(F.col("_t"), rules).alias("team_code"),
            )
        )
    # Text columns of a fixture list; column pruning drops them where unused.
    return base.select(
        "*",
        F.concat(prefix, F.lit("-KL")).alias("league"),
        F.when(F.col("is_home"), F.concat(F.lit("H"), F.col("org_id").cast("string"))).otherwise("X").alias("venue"),
        F.when(F.col("is_home"), own_side).otherwise(VISITOR).alias("home"),
        F.when(F.col("is_home"), VISITOR).otherwise(own_side).alias("away"),
    )


def clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Club name and own venue per organisation."""
    org = F.floor(F.col("c_custkey") / MEMBERS_PER_ORG).cast("int")
    return (
        spark.read.parquet(f"{sf_dir}/customer.parquet")
        .select(org.alias("org_id"))
        .distinct()
        .select(
            "org_id",
            F.concat(F.lit(CLUB_PREFIX), F.col("org_id").cast("string")).alias("club"),
            F.concat(F.lit("H"), F.col("org_id").cast("string")).alias("venue"),
        )
    )


def persons(spark: SparkSession, sf_dir: str, rules: Rules = DEFAULT_RULES, hot: bool = False) -> DataFrame:
    key = F.col("c_custkey")
    supervisor = key % 20 == 0
    return (
        spark.read.parquet(f"{sf_dir}/customer.parquet")
        .select("c_custkey", "c_name", "c_acctbal")
        .select(
            _org(key, hot).alias("org_id"),
            key.alias("person_id"),
            F.col("c_name").alias("name"),
            F.when(supervisor, SUPERVISOR_TEAM)
            .otherwise(_team_code(((key * 7) % 19).cast("int"), rules))
            .alias("team_code"),
            F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 20).cast("int").alias("worked_min"),
            supervisor.alias("is_supervisor"),
            F.when(key % 11 == 0, _team_code(((key * 5) % 31).cast("int"), rules)).alias("trains_team"),
        )
    )

