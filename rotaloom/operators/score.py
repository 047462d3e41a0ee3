"""Objective and rule check of a given roster.

A roster has one row per filled slot: org_id, shift_id, slot_nr, person_id.
Nothing here lists alternatives: the balance needs loads per person, proximity
is a lookup per filled slot, and the rules are counted over the roster itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.operators.candidates import CLASS, SHIFT, shift_facts, slot_facts, with_class
from rotaloom.operators.disjoin import coverage
from rotaloom.plans.scratch import materialize
from rotaloom.plans.skew import growing, salted_join
from rotaloom.rules import Rules

PROBLEM = ["org_id", "problem"]
PERSON = ["org_id", "person_id"]
# Minutes as exact decimals, so sums do not depend on partitioning.
MINUTES = "decimal(20,6)"


def problem_of_person(is_supervisor):
    return F.when(is_supervisor, "A").otherwise("KVW")


def active_workers(persons: DataFrame, cands: DataFrame, targets: DataFrame, rules: Rules) -> DataFrame:
    """Workers with at least one candidate and the minutes they still owe (right side of M2)."""
    classes = cands.select(*CLASS).distinct()
    goal = targets.select("org_id", "team_code", "target_min")
    able = salted_join(with_class(persons), classes, CLASS, "left_semi", ["person_id"], rules.salts)
    owing = F.coalesce(F.col("target_min"), F.lit(0.0)) - F.col("worked_min")
    return salted_join(able, goal, ["org_id", "team_code"], "left", ["person_id"], rules.salts).select(
        *PERSON,
        problem_of_person(F.col("is_supervisor")).alias("problem"),
        *CLASS[1:],
        owing.cast(MINUTES).alias("owing_min"),
    )


def filled_slots(roster: DataFrame, cands: DataFrame) -> DataFrame:
    """Roster rows of member shifts with the attributes of their shift."""
    return _with_facts(roster, shift_facts(cands))


def _with_facts(roster: DataFrame, facts: DataFrame) -> DataFrame:
    return roster.select(*SHIFT, "slot_nr", "person_id").join(growing(facts.drop("n_people")), SHIFT)


def balance(roster: DataFrame, workers: DataFrame, cands: DataFrame, rules: Rules) -> DataFrame:
    """M2 per worker: planned minutes, over- and undertime and their penalty."""
    return _balance(_with_facts(roster, slot_facts(cands)), workers, rules)


def _balance(filled: DataFrame, workers: DataFrame, rules: Rules) -> DataFrame:
    load = filled.groupBy(*PERSON).agg(F.sum("minutes").alias("load_min"))
    rest = F.coalesce(F.col("load_min"), F.lit(0)).cast(MINUTES) - F.col("owing_min")
    over, under = F.greatest(rest, F.lit(0).cast(MINUTES)), F.greatest(-rest, F.lit(0).cast(MINUTES))
    return workers.join(growing(load), PERSON, "left").select(
        *workers.columns,
        F.coalesce(F.col("load_min"), F.lit(0)).alias("load_min"),
        over.alias("over_min"),
        under.alias("under_min"),
        (over * rules.over_penalty + under * rules.under_penalty).cast(MINUTES).alias("penalty"),
    )


def proximity(roster: DataFrame, workers: DataFrame, cands: DataFrame, costs: DataFrame, rules: Rules) -> DataFrame:
    """M3 per filled slot."""
    return _proximity(filled_slots(roster, cands), workers, costs, rules)


def _proximity(filled: DataFrame, workers: DataFrame, costs: DataFrame, rules: Rules) -> DataFrame:
    team = workers.select(*PERSON, "team_code")
    return (
        filled.join(growing(team), PERSON)
        .join(growing(costs), [*SHIFT, "team_code"], "left")
        .withColumn("cost", F.coalesce(F.col("cost"), F.lit(rules.flat_cost)).cast("long"))
    )


def score(
    roster: DataFrame, workers: DataFrame, cands: DataFrame, costs: DataFrame, rules: Rules
) -> DataFrame:
    """Objective per organisation and problem, split into its two parts."""
    # Written once: both parts read it, and each would deal out the facts of all shifts again.
    filled = materialize(_with_facts(roster, slot_facts(cands)).select(*SHIFT, "slot_nr", "person_id", "problem", "minutes"), "filled")
    time = _balance(filled, workers, rules).groupBy(*PROBLEM).agg(
        F.sum("penalty").alias("balance_cost"), F.count(F.lit(1)).alias("n_workers")
    )
    near = _proximity(filled, workers, costs, rules).groupBy(*PROBLEM).agg(
        F.sum("cost").alias("proximity_cost"), F.count(F.lit(1)).alias("n_filled")
    )
    return time.join(near, PROBLEM, "left").select(
        *PROBLEM,
        "n_workers",
        F.coalesce(F.col("n_filled"), F.lit(0)).alias("n_filled"),
        "balance_cost",
        F.coalesce(F.col("proximity_cost"), F.lit(0)).alias("proximity_cost"),
        (F.col("balance_cost") + F.coalesce(F.col("proximity_cost"), F.lit(0))).alias("objective"),
    )


def lower_bound(workers: DataFrame, cands: DataFrame, costs: DataFrame, rules: Rules) -> DataFrame:
    """A bound no roster with exactly one helper per slot can beat, ignoring fixed rows.

    Every slot costs at least its cheapest proximity, and the total of all
    minutes against the total owed fixes the least possible balance penalty.
    """
    cheapest = (
        cands.select(*PROBLEM, "shift_id", "team_code", "minutes", "n_slots")
        .join(growing(costs), [*SHIFT, "team_code"], "left")
        .groupBy(*PROBLEM, "shift_id")
        .agg(
            F.min(F.coalesce(F.col("cost"), F.lit(rules.flat_cost))).alias("cost"),
            F.first("minutes").alias("minutes"),
            F.first("n_slots").alias("n_slots"),
        )
        .groupBy(*PROBLEM)
        .agg(
            F.sum(F.col("cost") * F.col("n_slots")).alias("least_proximity"),
            F.sum(F.col("minutes") * F.col("n_slots")).cast(MINUTES).alias("demand"),
        )
    )
    owed = workers.groupBy(*PROBLEM).agg(F.sum("owing_min").cast(MINUTES).alias("owed"))
    excess = F.col("demand") - F.col("owed")
    penalty = F.when(excess >= 0, excess * rules.over_penalty).otherwise(-excess * rules.under_penalty)
    return cheapest.join(owed, PROBLEM).select(
        *PROBLEM, (F.col("least_proximity") + penalty).cast(MINUTES).alias("lower_bound")
    )


def _finding(df: DataFrame, rule, activity) -> DataFrame:
    def column(name: str, kind: str):
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)

    return df.select(
        "org_id",
        rule.alias("rule"),
        column("shift_id", "string"),
        column("slot_nr", "int"),
        column("person_id", "long"),
        activity.cast("long").alias("activity"),
    )


def violations(
    roster: DataFrame,
    workers: DataFrame,
    cands: DataFrame,
    rules: Rules,
    fixed: DataFrame | None = None,
    all_cands: DataFrame | None = None,
) -> DataFrame:
    """Every broken rule with the number that breaks it.

    N1 a slot is not filled exactly once, N2 a person serves two shifts at once,
    N3 a helper has no team mate in the shift, N4 a fixed assignment is missing,
    SLOT a row names a shift or slot that does not exist, CANDIDATE the person is
    unknown or may not take the shift, GUARD supervisors and players are mixed up.

    ``all_cands`` are the candidates before the weekend rule, which ``fixed`` rows
    may use; without them fixed rows are held to ``cands`` as all others.
    """
    keys = [*SHIFT, "slot_nr", "person_id"]
    facts = slot_facts(cands)
    person = workers.select(*PERSON, *CLASS[1:])
    owned = roster.select(*keys).join(growing(facts.drop("n_people")), SHIFT, "left").join(growing(person), PERSON, "left")
    known = cands.select(*SHIFT, *CLASS[1:]).withColumn("_known", F.lit(True))
    owned = owned.join(growing(known), [*SHIFT, *CLASS[1:]], "left")
    if fixed is not None and all_cands is not None:
        allowed = all_cands.select(*SHIFT, *CLASS[1:]).join(growing(fixed.select(*keys)), SHIFT).select(*keys, *CLASS[1:])
        owned = owned.join(growing(allowed.withColumn("_fixed", F.lit(True))), [*keys, *CLASS[1:]], "left")
    else:
        owned = owned.withColumn("_fixed", F.lit(None).cast("boolean"))
    no_slot = F.col("n_slots").isNull() | ~F.col("slot_nr").between(0, F.col("n_slots") - 1)
    unable = ~no_slot & F.col("_known").isNull() & F.col("_fixed").isNull()
    mixed = ~no_slot & ((F.col("problem") == "A") != F.coalesce("is_supervisor", F.lit(False)))
    broken = F.array_compact(
        F.array(F.when(no_slot, "SLOT"), F.when(unable, "CANDIDATE"), F.when(mixed, "GUARD"))
    )
    found = [_finding(owned.withColumn("rule", F.explode(broken)), F.col("rule"), F.lit(1))]

    used = roster.groupBy(*SHIFT, "slot_nr").agg(F.count(F.lit(1)).alias("n"))
    slots = facts.select(*SHIFT, F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1)).alias("slot_nr"))
    n1 = (
        slots.join(growing(used), [*SHIFT, "slot_nr"], "left")
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
        .filter("n <> 1")
    )
    found.append(_finding(n1, F.lit("N1"), F.col("n")))
    if not rules.team_mode:
        kvw = _with_facts(roster, facts).filter("problem = 'KVW'").join(growing(person), PERSON, "left")
        busy = coverage(kvw, [*PERSON, "shift_date"]).filter("n_covering > 1")
        n2 = busy.groupBy(*PERSON).agg(F.count(F.lit(1)).alias("n"))
        found.append(_finding(n2, F.lit("N2"), F.col("n")))
        found.append(_finding(lonely_helpers(kvw, cands), F.lit("N3"), F.col("n_mates")))
    if fixed is not None:
        n4 = fixed.select(*keys).join(growing(roster.select(*keys)), keys, "left_anti")
        found.append(_finding(n4, F.lit("N4"), F.lit(0)))
    return reduce(DataFrame.unionByName, found)


def lonely_helpers(kvw: DataFrame, cands: DataFrame) -> DataFrame:
    """Helpers without another person of their team on another slot of the shift.

    The rule binds only where the team offers a second person, as in the model.
    Mates are counted by inclusion and exclusion over small per-shift totals.
    """
    team = [*SHIFT, "team_code"]
    offered = (
        cands.filter("n_slots > 1").groupBy(*team).agg(F.sum("n_persons").alias("n_offered")).filter("n_offered > 1")
    )
    bound = kvw.join(growing(offered), team)
    total = bound.groupBy(*team).agg(F.count(F.lit(1)).alias("n_all"))
    by_slot = bound.groupBy(*team, "slot_nr").agg(F.count(F.lit(1)).alias("n_slot"))
    by_person = bound.groupBy(*team, "person_id").agg(F.count(F.lit(1)).alias("n_person"))
    both = bound.groupBy(*team, "slot_nr", "person_id").agg(F.count(F.lit(1)).alias("n_both"))
    return (
        both.join(growing(total), team)
        .join(growing(by_slot), [*team, "slot_nr"])
        .join(growing(by_person), [*team, "person_id"])
        .withColumn("n_mates", F.expr("n_all - n_slot - n_person + n_both"))
        .filter("n_mates = 0")
    )
