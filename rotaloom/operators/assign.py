"""Round-based assigner.

Open shifts propose to teams, teams hand the proposals to their members, and a
proposal is accepted when its exact marginal cost is no worse than what the
shift's next-best team would charge.  Everything is a join, a grouped
aggregation or a window whose groups are bounded by the shifts of one
organisation; members are numbered in spread buckets, and shifts meet members
by position instead of by listing all pairs.

Marginal costs within a round assume that all earlier proposals of the round
are accepted.  The time penalty is convex, so that estimate is never too low,
accepted improvements never raise the objective, and the outcome does not
depend on partitioning.

Every organisation and problem goes through the rounds by itself: a state table has
its tolerance and whether it goes on, so its roster is the same alone and beside any others.
In team mode, where a few representatives serve each organisation, improvement exchanges
slots along chains: a slot moves to another member, two slots change places, or a
slot pushes another one of the same length out to a third member.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.operators.candidates import CLASS, SHIFT, open_slots, with_class
from rotaloom.operators.score import PERSON, PROBLEM
from rotaloom.plans.scratch import Scratch
from rotaloom.plans.skew import spread_row_number
from rotaloom.rules import Rules

LANE = ["org_id", "problem", "team_code"]
SLOT = [*SHIFT, "slot_nr"]
UNIT = ["org_id", "problem", "shift_id", "shift_date", "start_min", "end_min", "minutes", "n_slots"]
CHOSEN = ["org_id", "problem", "shift_id", "slot_nr", "person_id", "is_fixed"]
ANY_COST = 1e18
# A round that fills less than SHARE of the open slots widens the tolerance GROWTH times; the last REST of the
# slots are taken at any cost, as improvement follows.
SHARE, REST, FIRST_SLACK, GROWTH = 0.25, 0.02, 30.0, 16
# Slots of one length that a member hands to another in one round, and the least gain of an exchange.
UNITS, LEAST = 8, 1e-6


@dataclass
class Assignment:
    """Result of a run; every table is written and can be read again cheaply."""

    roster: DataFrame
    slots: DataFrame
    workers: DataFrame
    rounds: list[dict] = field(default_factory=list)

    def uncovered(self) -> DataFrame:
        return self.slots.join(self.roster.select(*SLOT), SLOT, "left_anti")

    def require_complete(self) -> "Assignment":
        """Fail instead of handing on a roster with open slots."""
        if not self.uncovered().isEmpty():
            raise ValueError("some slots could not be filled")
        return self

    def status(self, impossible: DataFrame | None = None) -> DataFrame:
        """One row per organisation and problem.

        With the witnesses of ``feasible.impossible_moments`` an incomplete roster that nothing could complete
        is 'infeasible'; without a witness it is only not found.
        """
        if impossible is not None:
            proven = impossible.select("org_id", F.lit("KVW").alias("problem"), F.lit(True).alias("_proven")).distinct()
            told = self.status().join(proven, ["org_id", "problem"], "left")
            none = F.col("_proven") & (F.col("status") != "complete")
            return told.withColumn("status", F.when(none, "infeasible").otherwise(F.col("status"))).drop("_proven")
        filled = self.roster.select(*SLOT, F.lit(1).alias("filled"))
        return (
            self.slots.join(filled, SLOT, "left")
            .groupBy("org_id", "problem")
            .agg(F.count(F.lit(1)).alias("n_slots"), F.count("filled").alias("n_filled"))
            .withColumn(
                "status",
                F.when(F.col("n_filled") == F.col("n_slots"), "complete")
                .when(F.col("n_filled") == 0, "empty")
                .otherwise("partial"),
            )
        )


@dataclass
class _State:
    rules: Rules
    slots: DataFrame
    lanes: DataFrame
    workers: DataFrame
    chosen: DataFrame
    scratch: Scratch
    optional: bool = False

    def replace_chosen(self, chosen: DataFrame) -> None:
        """Write the new roster and delete the one it supersedes."""
        self.chosen = self.replace(chosen, "chosen")

    def replace(self, table: DataFrame, name: str) -> DataFrame:
        """Write the next version of a table and delete the one it supersedes."""
        return self.scratch.replace(table, name)

    def only(self, rows: DataFrame, going: DataFrame) -> DataFrame:
        """Rows of the organisations and problems in ``going``, of which there are two for each organisation."""
        return rows.join(going.select(*PROBLEM), PROBLEM, "left_semi")

    def stage_rested(self) -> DataFrame:
        """``rested`` as a table, for the several uses of one round."""
        return self.scratch.keep(self.rested(), "rested", "rested")

    def worthwhile(self, cost: Column) -> Column:
        """With optional cover a slot is filled only if that lowers the objective."""
        return cost < 0 if self.optional else F.lit(True)

    def open(self) -> DataFrame:
        return self.slots.join(self.chosen.select(*SLOT), SLOT, "left_anti")

    def held(self) -> DataFrame:
        """Chosen slots with the attributes of their shift."""
        return self.chosen.join(self.slots.drop("problem"), SLOT)

    def rested(self) -> DataFrame:
        """Workers with the minutes they are still short of their target."""
        load = self.held().groupBy(*PERSON).agg(F.sum("minutes").alias("load"))
        rest = F.col("owing_min").cast("double") - F.coalesce(F.col("load"), F.lit(0))
        return self.workers.join(load, PERSON, "left").withColumn("rest", rest).drop("load", "owing_min")

    def coupled(self) -> Column:
        """Shifts whose helpers must come from one team."""
        return F.lit(not self.rules.team_mode) & (F.col("n_slots") > 1)


def _penalty(rest: Column, rules: Rules) -> Column:
    zero = F.lit(0.0)
    return F.greatest(-rest, zero) * rules.over_penalty + F.greatest(rest, zero) * rules.under_penalty


def added_cost(rest: Column, minutes: Column, rules: Rules) -> Column:
    return _penalty(rest - minutes, rules) - _penalty(rest, rules)


def saved_cost(rest: Column, minutes: Column, rules: Rules) -> Column:
    return _penalty(rest, rules) - _penalty(rest + minutes, rules)


def _hash(*parts) -> Column:
    return F.xxhash64(*[F.col(p) if isinstance(p, str) else F.lit(p) for p in parts])


def _lanes(offers: DataFrame) -> DataFrame:
    """Teams that may serve a shift, with cost, free members and the coaching groups that are free."""
    return offers.groupBy("org_id", "shift_id", "team_code").agg(
        F.min("cost").alias("cost"),
        F.sum("n_persons").alias("n_free"),
        F.collect_set("coach_of").alias("free_groups"),
    )


def _units(state: _State, open_: DataFrame) -> DataFrame:
    units = open_.groupBy(*UNIT).agg(F.count(F.lit(1)).cast("int").alias("need"))
    if state.rules.team_mode:
        return units.withColumn("anchor", F.lit(None).cast("string"))
    # A half-filled shift that needs one team stays with the team it has.
    anchors = (
        state.held()
        .filter("n_slots > 1")
        .join(state.workers.select(*PERSON, "team_code"), PERSON)
        .groupBy(*SHIFT)
        .agg(F.min("team_code").alias("anchor"))
    )
    return units.join(anchors, SHIFT, "left")


def _eligible(state: _State, units: DataFrame) -> DataFrame:
    """Open shifts with the teams that can staff them completely."""
    pairs = units.join(state.lanes, SHIFT)
    if state.rules.team_mode:
        return pairs
    fits = ~state.coupled() | F.when(
        F.col("anchor").isNull(), F.col("n_free") >= F.col("need")
    ).otherwise(F.col("team_code") == F.col("anchor"))
    return pairs.filter(fits)


def _without_clashes(state: _State, proposals: DataFrame) -> DataFrame:
    """Player mode: drop proposals that overlap a shift the person already has."""
    if state.rules.team_mode:
        return proposals
    held = state.held().filter("problem = 'KVW'").select(
        "org_id", "person_id", "shift_date", F.col("start_min").alias("h_start"), F.col("end_min").alias("h_end")
    )
    p, h = proposals.alias("p"), held.alias("h")
    clash = (
        (F.col("p.org_id") == F.col("h.org_id"))
        & (F.col("p.person_id") == F.col("h.person_id"))
        & (F.col("p.shift_date") == F.col("h.shift_date"))
        & (F.col("p.problem") == "KVW")
        & (F.col("p.start_min") < F.col("h.h_end"))
        & (F.col("h.h_start") < F.col("p.end_min"))
    )
    return p.join(h, clash, "left_anti")


def _ranked(state: _State, rested: DataFrame, seed: int) -> DataFrame:
    """Members of each team numbered from the largest shortfall down, half-hour steps first."""
    return spread_row_number(
        rested,
        LANE,
        [-F.floor(F.col("rest") / 30)],
        F.shiftright(_hash("person_id", seed), 52),
        [_hash("person_id", seed), F.col("person_id")],
        "position",
    )


def _propose(state: _State, seed: int, going: DataFrame) -> DataFrame:
    """One round: every open shift of ``going`` asks its cheapest team; returns the accepted slots."""
    rules = state.rules
    open_ = state.only(state.open(), going)
    rested = state.stage_rested()
    heads = rested.groupBy(*LANE).agg(F.max("rest").alias("head_rest"), F.count(F.lit(1)).alias("n_members"))
    asking = _eligible(state, _units(state, open_)).join(heads, LANE).withColumn(
        "asked", added_cost(F.col("head_rest"), F.col("minutes"), rules) + F.col("cost")
    )
    # At most one row per team and shift; proposals per team are bounded by the shifts.
    by_cost = Window.partitionBy(*SHIFT).orderBy("asked", _hash("shift_id", "team_code", seed), "team_code")
    in_lane = Window.partitionBy(*LANE).orderBy("asked", _hash("shift_id", seed), "shift_id")
    best = (
        asking.withColumn("choice", F.row_number().over(by_cost))
        .withColumn("next_best", F.lead("asked").over(by_cost))
        .filter("choice = 1")
        .withColumn("turn", F.row_number().over(in_lane))
    )
    in_unit = Window.partitionBy(*SHIFT).orderBy("slot_nr")
    numbered = open_.select(*SLOT).withColumn("k", F.row_number().over(in_unit) - 1)
    width = max(d.n_people for d in rules.duties)
    # Every other round starts at a random member, so that a member who cannot
    # serve does not hold up the same shift again and again.
    shift_by = F.pmod(_hash("shift_id", seed), F.col("n_members")) if seed % 2 == 0 else F.lit(0)
    place = F.pmod((F.col("turn") - 1) * width + F.col("k") + shift_by, F.col("n_members")) + 1
    proposals = (
        best.join(going.select(*PROBLEM, "slack"), PROBLEM)
        .join(numbered, SHIFT)
        .withColumn("position", place.cast("long"))
        .join(_ranked(state, rested, seed), [*LANE, "position"])
        .filter(F.array_contains("free_groups", F.col("coach_of")))
    )
    before = (
        Window.partitionBy(*PERSON).orderBy("turn", "shift_id", "slot_nr").rowsBetween(Window.unboundedPreceding, -1)
    )
    taken = F.coalesce(F.sum("minutes").over(before), F.lit(0))
    exact = added_cost(F.col("rest") - taken, F.col("minutes"), rules) + F.col("cost")
    # Without another team the alternative is another member, or nobody at all.
    fallback = F.when(F.col("n_members") == 1, ANY_COST).otherwise(F.col("asked"))
    limit = F.greatest(F.coalesce(F.col("next_best"), fallback), F.col("asked") + F.col("slack"))
    accepted = proposals.withColumn("fine", (exact <= limit) & state.worthwhile(exact)).filter("fine")
    fine = _without_clashes(state, accepted)
    if not rules.team_mode:
        per_day = Window.partitionBy(*PERSON, "shift_date").orderBy("turn", "shift_id", "slot_nr")
        fine = fine.withColumn("_nr", F.row_number().over(per_day)).filter("_nr = 1").drop("_nr")
    whole = Window.partitionBy(*SHIFT)
    complete = F.count(F.lit(1)).over(whole) >= F.when(state.coupled(), F.col("need")).otherwise(1)
    return fine.withColumn("complete", complete).filter("complete").select(
        *CHOSEN[:-1], F.lit(False).alias("is_fixed")
    )


def _settle(state: _State, seed: int, alone: bool, going: DataFrame) -> DataFrame:
    """Exact pass for the shifts the rounds left open.

    The penalty is convex, so the cheapest members of a class are those with the
    largest shortfall.  A shift therefore looks only at the first ``need`` members of
    each class and as many more as have a duty on that day; what it reads is bounded
    by the shifts and not by the members.  The cheapest complete staffing per shift
    is kept, and shifts that come first for all members they want are accepted.
    ``alone`` fills single slots from teams that offer one member only, which the
    team rule does not bind.
    """
    rules = state.rules
    open_ = state.only(state.open(), going)
    rested = state.stage_rested()
    if alone:
        units = open_.withColumn("need", F.lit(1)).withColumn("anchor", F.lit(None).cast("string"))
        pairs = units.join(state.lanes.filter("n_free = 1"), SHIFT)
    else:
        units = _units(state, open_).withColumn("slot_nr", F.lit(-1))
        pairs = _eligible(state, units)
    members = _first_members(state, pairs, rested)
    priced = _without_clashes(state, members).withColumn(
        "asked", added_cost(F.col("rest"), F.col("minutes"), rules) + F.col("cost")
    ).filter(state.worthwhile(F.col("asked")))
    # Cheapest members per shift and team, first within spread buckets.
    order = [F.col("asked"), _hash("shift_id", "slot_nr", "person_id", seed), F.col("person_id")]
    spread = F.pmod(F.xxhash64("person_id"), F.lit(rules.salts))
    team = [*SHIFT, "slot_nr", "team_code"]
    bucket = Window.partitionBy(*team, "_salt").orderBy(*order)
    final = Window.partitionBy(*team).orderBy(*order)
    need = F.when(state.coupled() | F.lit(alone), F.col("need")).otherwise(1)
    width = max(d.n_people for d in rules.duties)
    cheapest = (
        priced.withColumn("_salt", spread)
        .withColumn("_nr", F.row_number().over(bucket))
        # A constant limit lets every task drop the rest before the shuffle.
        .filter(F.col("_nr") <= width)
        .withColumn("_nr", F.row_number().over(final))
        .filter(F.col("_nr") <= need)
    )
    per_team = Window.partitionBy(*team)
    staffed = cheapest.withColumn("total", F.sum("asked").over(per_team)).withColumn(
        "staff", F.count(F.lit(1)).over(per_team)
    ).filter(F.col("staff") == need)
    per_shift = Window.partitionBy(*SHIFT, "slot_nr").orderBy(
        "total", _hash("shift_id", "team_code", seed), "team_code"
    )
    wanted = staffed.withColumn("_team", F.dense_rank().over(per_shift)).filter("_team = 1")
    first = Window.partitionBy(*PERSON).orderBy("total", "shift_id", "slot_nr")
    wins = wanted.withColumn("_first", F.row_number().over(first) == 1)
    together = Window.partitionBy(*SHIFT, "slot_nr")
    accepted = wins.withColumn("_all", F.min("_first").over(together)).filter("_all").select(
        "org_id", "problem", "shift_id", F.col("slot_nr").alias("_slot"), "person_id", "_nr"
    )
    if alone:
        return accepted.select(
            "org_id", "problem", "shift_id", F.col("_slot").alias("slot_nr"), "person_id",
            F.lit(False).alias("is_fixed"),
        )
    in_unit = Window.partitionBy(*SHIFT).orderBy("slot_nr")
    numbered = open_.select(*SLOT).withColumn("_nr", F.row_number().over(in_unit))
    return accepted.drop("_slot").join(numbered, [*SHIFT, "_nr"]).select(
        *CHOSEN[:-1], F.lit(False).alias("is_fixed")
    )


def _first_members(state: _State, pairs: DataFrame, rested: DataFrame) -> DataFrame:
    """Open shifts with the members of each free class who may be among its cheapest."""
    group = [*LANE, "coach_of"]
    ranked = spread_row_number(
        rested,
        group,
        [-F.floor(F.col("rest"))],
        F.shiftright(F.xxhash64("person_id"), 52),
        [F.desc("rest"), F.col("person_id")],
        "position",
    )
    sizes = rested.groupBy(*group).agg(F.count(F.lit(1)).alias("n_class"))
    busy = (
        state.held()
        .join(rested.select(*PERSON, "team_code", "coach_of"), PERSON)
        .groupBy(*group, "shift_date")
        .agg(F.count_distinct("person_id").alias("n_busy"))
    )
    asked = (
        pairs.withColumn("coach_of", F.explode("free_groups"))
        .join(sizes, group)
        .join(busy, [*group, "shift_date"], "left")
        .withColumn("_most", F.least(F.col("need") + F.coalesce("n_busy", F.lit(0)), F.col("n_class")))
        .withColumn("position", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_most").cast("long"))))
        .drop("n_class", "n_busy", "_most")
    )
    return asked.join(ranked, [*group, "position"]).drop("position")


def _improve(state: _State, seed: int, going: DataFrame) -> DataFrame:
    """One improvement round: slots whose transfer to another member pays off.

    Only slots of the organisations and problems in ``going`` are looked at.
    A hash splits the members into givers and takers, so gains of one round do
    not interfere.  Shifts bound to one team move between its members only.
    """
    rules = state.rules
    rested = state.stage_rested().withColumn("takes", F.pmod(_hash("person_id", seed), F.lit(2)) == 1)
    givers = rested.filter("not takes").select(
        *PERSON, F.col("team_code").alias("old_team"), F.col("rest").alias("old_rest")
    )
    takers = rested.filter("takes")
    heads = takers.groupBy(*LANE).agg(F.max("rest").alias("head_rest"), F.count(F.lit(1)).alias("n_members"))
    free = state.held().filter("not is_fixed")
    held = state.only(free, going).join(givers, PERSON)
    old_lane = state.lanes.select(*SHIFT, F.col("team_code").alias("old_team"), F.col("cost").alias("old_cost"))
    offered = (
        held.withColumnRenamed("person_id", "old_person")
        .join(old_lane, [*SHIFT, "old_team"])
        .join(state.lanes, SHIFT)
        .filter(~state.coupled() | (F.col("team_code") == F.col("old_team")))
        .join(heads, LANE)
        .withColumn(
            "hoped",
            saved_cost(F.col("old_rest"), F.col("minutes"), rules)
            + F.col("old_cost")
            - F.col("cost")
            - added_cost(F.col("head_rest"), F.col("minutes"), rules),
        )
        .filter("hoped > 0")
    )
    # Teams whose gain is within a factor of two share the offers, so one round
    # serves many takers instead of sending everybody to the same one.
    step = F.floor(F.log2("hoped"))
    by_gain = Window.partitionBy(*SLOT).orderBy(
        F.desc(step), _hash("shift_id", "slot_nr", "team_code", seed), "team_code"
    )
    in_lane = Window.partitionBy(*LANE).orderBy(F.desc("hoped"), _hash("shift_id", seed), "shift_id", "slot_nr")
    best = (
        offered.withColumn("_choice", F.row_number().over(by_gain))
        .filter("_choice = 1")
        .withColumn("turn", F.row_number().over(in_lane))
        .withColumn("position", (F.pmod(F.col("turn") - 1, F.col("n_members")) + 1).cast("long"))
    )
    moves = best.join(_ranked(state, takers, seed), [*LANE, "position"]).filter(
        F.array_contains("free_groups", F.col("coach_of"))
    )
    if not rules.team_mode:
        per_day = Window.partitionBy(*PERSON, "shift_date").orderBy("turn", "shift_id", "slot_nr")
        moves = _without_clashes(state, moves).withColumn("_nr", F.row_number().over(per_day)).filter("_nr = 1")
    order = ["turn", "shift_id", "slot_nr"]
    to_taker = Window.partitionBy(*PERSON).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    from_giver = (
        Window.partitionBy("org_id", "old_person").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    added = F.coalesce(F.sum("minutes").over(to_taker), F.lit(0))
    released = F.coalesce(F.sum("minutes").over(from_giver), F.lit(0))
    gain = (
        saved_cost(F.col("old_rest") + released, F.col("minutes"), rules)
        + F.col("old_cost")
        - F.col("cost")
        - added_cost(F.col("rest") - added, F.col("minutes"), rules)
    )
    return moves.withColumn("gain", gain).filter("gain > 1e-6").select(*SLOT, "problem", "person_id", "gain")


def _edges(state: _State, rested: DataFrame, going: DataFrame) -> DataFrame:
    """Team mode: the slots of each length that a giver hands to a taker at the least change of proximity.

    Representatives are bounded by the teams, so the result is bounded for each organisation
    by the pairs of them, the lengths and UNITS.
    """
    givers = rested.select(*PERSON, F.col("team_code").alias("old_team"))
    old_lane = state.lanes.select(*SHIFT, F.col("team_code").alias("old_team"), F.col("cost").alias("old_cost"))
    takers = rested.select(*LANE, "coach_of", F.col("person_id").alias("taker"))
    offers = (
        state.only(state.held().filter("not is_fixed"), going)
        .join(givers, PERSON)
        .join(old_lane, [*SHIFT, "old_team"])
        .join(state.lanes, SHIFT)
        .join(takers, LANE)
        .filter(F.array_contains("free_groups", F.col("coach_of")) & (F.col("person_id") != F.col("taker")))
    )
    key = [*PROBLEM, "minutes", "giver", "taker"]
    delta = (F.col("cost") - F.col("old_cost")).cast("double").alias("delta")
    priced = offers.select(
        *PROBLEM, "minutes", F.col("person_id").alias("giver"), "taker",
        F.struct(delta, F.xxhash64("shift_id", "slot_nr").alias("tie"), "shift_id", "slot_nr").alias("slot"),
    )
    first = priced.withColumn("_nr", F.row_number().over(Window.partitionBy(*key).orderBy("slot"))).filter(F.col("_nr") <= UNITS)
    return first.groupBy(*key).agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def _chains(state: _State, going: DataFrame, linked: bool) -> DataFrame:
    """Team mode: one improvement round by exchanges that pay off and share no member.

    A chain moves up to UNITS slots of one length from one member to another, as long as each pays off
    by itself.  If ``linked`` it may also be a swap of two slots of any lengths or an ejection, where the slot that a member takes pushes out one of the same length to a third member.  Of the
    chains between the same first and last member the best is kept; from the best of an organisation and problem
    down, a chain is taken if none of its members is in one taken before.  So the gains of a
    round add up and the objective falls by exactly their sum.
    """
    rules = state.rules
    rested = state.stage_rested()
    edges = state.scratch.keep(_edges(state, rested, going), "edges", "edges")

    def side(prefix: str) -> DataFrame:
        return rested.select(*PROBLEM, F.col("person_id").alias(prefix), F.col("rest").alias(f"{prefix}_rest"))

    def move(slot: str, taker: str) -> Column:
        return F.struct(F.col(f"{slot}.shift_id"), F.col(f"{slot}.slot_nr"), F.col(taker).alias("person_id"))

    def chains(df: DataFrame, gain: Column, nodes: list[str], moves: Column) -> DataFrame:
        return df.select(*PROBLEM, gain.alias("gain"), F.array(*nodes).alias("nodes"), moves.alias("moves")).filter(
            F.col("gain") > LEAST
        )

    priced = edges.join(side("giver"), [*PROBLEM, "giver"]).join(side("taker"), [*PROBLEM, "taker"])
    minutes = F.col("minutes")

    def gain_of(slot: Column, nr: Column) -> Column:
        moved = nr * minutes
        saved = saved_cost(F.col("giver_rest") + moved, minutes, rules)
        return saved - added_cost(F.col("taker_rest") - moved, minutes, rules) - slot["delta"]

    # Gains fall from slot to slot, so those that pay off come first.
    paying = F.filter(F.transform("slots", gain_of), lambda g: g > LEAST)
    handed = F.transform(
        F.slice("slots", 1, F.size(paying)),
        lambda x: F.struct(x["shift_id"].alias("shift_id"), x["slot_nr"].alias("slot_nr"), F.col("taker").alias("person_id")),
    )
    found = chains(priced, F.aggregate(paying, F.lit(0.0), lambda a, g: a + g), ["giver", "taker"], handed)
    priced = priced.withColumn("slot", F.element_at("slots", 1))
    saved, added = saved_cost(F.col("giver_rest"), minutes, rules), added_cost(F.col("taker_rest"), minutes, rules)
    if linked:
        first = priced.select(
            *PROBLEM, F.col("giver").alias("a"), F.col("taker").alias("b"), F.col("minutes").alias("m1"),
            F.col("slot").alias("s1"), F.col("giver_rest").alias("a_rest"), F.col("taker_rest").alias("b_rest"), saved.alias("saved"),
        )
        second = priced.select(
            *PROBLEM, F.col("giver").alias("b"), F.col("taker").alias("c"), F.col("minutes").alias("m2"),
            F.col("slot").alias("s2"), added.alias("added"),
        )
        more = F.col("m1") - F.col("m2")
        swaps = first.filter("a < b").join(second.withColumnRenamed("c", "a"), [*PROBLEM, "a", "b"])
        both = (
            saved_cost(F.col("a_rest"), more, rules)
            - added_cost(F.col("b_rest"), more, rules)
            - F.col("s1.delta")
            - F.col("s2.delta")
        )
        found = found.unionByName(chains(swaps, both, ["a", "b"], F.array(move("s1", "b"), move("s2", "a"))))
        pushed = first.join(second.withColumnRenamed("m2", "m1"), [*PROBLEM, "b", "m1"]).filter("a <> c")
        through = F.col("saved") - F.col("added") - F.col("s1.delta") - F.col("s2.delta")
        found = found.unionByName(chains(pushed, through, ["a", "b", "c"], F.array(move("s1", "b"), move("s2", "c"))))
    ends = [F.element_at("nodes", 1).alias("_first"), F.element_at("nodes", -1).alias("_last")]
    best = found.groupBy(*PROBLEM, *ends).agg(F.max(F.struct("gain", "nodes", "moves")).alias("chain"))
    # At most one chain for each pair of representatives, so the list is bounded.
    listed = best.groupBy(*PROBLEM).agg(F.sort_array(F.collect_list("chain"), asc=False).alias("chains"))
    kind = listed.schema["chains"].dataType.simpleString()
    none = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast(kind).alias("taken"))
    taken = F.aggregate(
        "chains",
        none,
        lambda kept, x: F.when(F.arrays_overlap(kept["used"], x["nodes"]), kept).otherwise(
            F.struct(F.concat(kept["used"], x["nodes"]).alias("used"), F.concat(kept["taken"], F.array(x)).alias("taken"))
        ),
    )
    return (
        listed.select(*PROBLEM, F.explode(taken["taken"]).alias("chain"))
        .select(*PROBLEM, F.col("chain.gain").alias("gain"), F.posexplode("chain.moves").alias("_nr", "move"))
        .select("org_id", "move.shift_id", "move.slot_nr", "problem", "move.person_id",
                F.when(F.col("_nr") == 0, F.col("gain")).otherwise(0.0).alias("gain"))
    )


def _next_slack() -> Column:
    """Tolerance of the next round: it grows while a round fills little of what is open."""
    wider = F.when(F.col("slack") > 0, F.col("slack") * GROWTH).otherwise(FIRST_SLACK)
    last = F.col("left") <= REST * F.col("n_slots")
    return F.when(last, ANY_COST).when(F.col("filled") >= SHARE * (F.col("left") + F.col("filled")), F.col("slack")).otherwise(wider)


def _objectives(state: _State) -> DataFrame:
    """Balance penalty and proximity of the current choice, per organisation and problem."""
    time = state.rested().groupBy(*PROBLEM).agg(F.sum(_penalty(F.col("rest"), state.rules)).alias("_time"))
    teams = state.workers.select(*PERSON, "team_code")
    near = state.held().join(teams, PERSON).join(state.lanes.select(*SHIFT, "team_code", "cost"), [*SHIFT, "team_code"])
    near = near.groupBy(*PROBLEM).agg(F.sum("cost").alias("_near"))
    objective = F.coalesce("_time", F.lit(0.0)) + F.coalesce("_near", F.lit(0))
    return time.join(near, PROBLEM, "left").select(*PROBLEM, objective.cast("double").alias("objective"))


def assign(
    cands: DataFrame,
    workers: DataFrame,
    rules: Rules,
    fixed: DataFrame | None = None,
    least_gain: float = 0.003,
    cover: str = "exactly_one",
) -> Assignment:
    """Fill the slots of the candidates at low cost under N1 to N4.

    For each organisation and problem by itself, rounds go on while they fill slots, with a
    tolerance that grows as they fill fewer, and improvement goes on until a round gains no more than
    ``least_gain`` of its own objective (two in a row where chance picks the moves).

    ``cover='exactly_one'`` fills every slot somebody can take; ``at_most_one``
    fills a slot only where that lowers the objective.

    ``cands`` are free candidates with a ``cost`` column and ``workers`` comes
    from ``active_workers``; both should be stage tables.  The driver sees one
    number per round, the count of newly filled or moved slots, and the sum of the gains.
    """
    if cover not in ("exactly_one", "at_most_one"):
        raise ValueError(f"unknown cover {cover}")
    scratch = Scratch(cands.sparkSession)
    lanes = scratch.keep(_lanes(cands), "lanes", "lanes")
    slots = scratch.keep(open_slots(cands).select(*UNIT, "slot_nr"), "slots", "slots")
    chosen = slots.limit(0).select(
        *CHOSEN[:-2], F.lit(None).cast("long").alias("person_id"), F.lit(False).alias("is_fixed")
    )
    if fixed is not None:
        one = fixed.groupBy(*SLOT).agg(F.min("person_id").alias("person_id"))
        seeds = slots.join(one, SLOT).select(*CHOSEN[:-1], F.lit(True).alias("is_fixed"))
        chosen = chosen.unionByName(seeds)
    state = _State(rules, slots, lanes, workers, chosen, scratch, cover == "at_most_one")
    state.replace_chosen(chosen)
    rounds: list[dict] = []
    parts = [scratch.paths["chosen"]]

    def fill(step: str, groups: DataFrame, round_of, following) -> tuple[DataFrame, bool]:
        """One filling round of the groups that go on, the groups' state after it, and whether any goes on."""
        going = groups.filter("going")
        slot = f"filled{len(rounds)}"
        filled = scratch.keep(round_of(going), "filled", slot)
        n = filled.groupBy(*PROBLEM).agg(F.count(F.lit(1)).alias("filled"))
        after = groups.drop("filled").join(n, PROBLEM, "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
        after = after.withColumn("left", F.col("left") - F.col("filled"))
        # A group that is over keeps its state.
        after = after.select(
            *PROBLEM, "n_slots", "left", "filled", *[F.when(F.col("going"), c).otherwise(F.col(k)).alias(k) for k, c in following.items()]
        )
        groups = state.replace(after, "groups")
        total, more = groups.agg(F.sum("filled"), F.max("going")).first()
        rounds.append({"step": step, "slots": total})
        if total:
            parts.append(scratch.paths[slot])
            state.chosen = scratch.spark.read.schema(state.chosen.schema).parquet(*parts)
        scratch.remove("rested")
        return groups, more

    # Every round but a group's last fills something, or widens its tolerance, so the loops end.
    open_now = state.open().groupBy(*PROBLEM).agg(F.count(F.lit(1)).alias("left"))
    blank = slots.groupBy(*PROBLEM).agg(F.count(F.lit(1)).alias("n_slots")).join(open_now, PROBLEM, "left").select(
        *PROBLEM, "n_slots", F.coalesce("left", F.lit(0)).alias("left")
    )
    start = [F.lit(0).cast("long").alias("filled"), F.lit(0.0).alias("slack")]
    groups = state.replace(blank.select("*", *start, (F.col("left") > 0).alias("going")), "groups")
    seed, more = 0, not groups.filter("going").isEmpty()
    while more:
        seed += 1
        # A round without a taker, once the tolerance is open, hands over to the exact pass.
        over = (F.col("left") == 0) | ((F.col("filled") == 0) & (F.col("slack") > 0))
        following = {"slack": _next_slack(), "going": ~over}
        groups, more = fill("propose", groups, lambda going: _propose(state, seed, going), following)
    for alone in (False,) if rules.team_mode else (False, True):
        groups, seed = state.replace(groups.withColumn("going", F.col("left") > 0), "groups"), 2000 + 1000 * alone
        more = not groups.filter("going").isEmpty()
        while more:
            seed += 1
            following = {"slack": F.col("slack"), "going": (F.col("left") > 0) & (F.col("filled") > 0)}
            step = "single" if alone else "settle"
            groups, more = fill(step, groups, lambda going: _settle(state, seed, alone, going), following)

    state.replace_chosen(state.chosen)
    scratch.remove(*[f"filled{i}" for i in range(len(rounds))])

    def improve(steps: str, patience: int, round_of) -> None:
        """Rounds of moves; a group leaves after ``patience`` rounds in a row that gain little."""
        nonlocal groups
        groups, seed = state.replace(_objectives(state).withColumn("quiet", F.lit(0)), "groups"), 1000
        while not (going := groups.filter(F.col("quiet") < patience)).isEmpty():
            seed += 1
            moves = scratch.keep(round_of(seed, going), "moves", "moves")
            n, gain = moves.agg(F.count(F.lit(1)), F.coalesce(F.sum("gain"), F.lit(0.0))).first()
            rounds.append({"step": steps, "slots": n, "gain": gain})
            if n:
                kept = state.chosen.join(moves.select(*SLOT, F.col("person_id").alias("_new")), SLOT, "left")
                state.replace_chosen(kept.withColumn("person_id", F.coalesce("_new", "person_id")).select(*CHOSEN))
            gained = moves.groupBy(*PROBLEM).agg(F.sum("gain").alias("gain"))
            gained = groups.join(gained, PROBLEM, "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
            still = F.col("gain") <= least_gain * F.abs("objective")
            quiet = F.when((F.col("quiet") >= patience) | still, F.col("quiet") + 1).otherwise(0)
            objective = F.col("objective") - F.col("gain")
            groups = state.replace(gained.select(*PROBLEM, objective.alias("objective"), quiet.alias("quiet")), "groups")
            scratch.remove("moves", "rested", "edges")

    if rules.team_mode:
        improve("move", 1, lambda seed, going: _chains(state, going, linked=False))
        improve("chain", 1, lambda seed, going: _chains(state, going, linked=True))
    else:
        # Givers and takers change at random, so one quiet round may be bad luck.
        improve("improve", 2, lambda seed, going: _improve(state, seed, going))
    scratch.remove("lanes", "groups")
    return Assignment(state.chosen, slots, workers, rounds)


def one_pass_roster(cands: DataFrame, persons: DataFrame, rules: Rules) -> DataFrame:
    """A plain roster by rule: cheapest class per shift, its least-worked person in every slot.

    Ties rotate over days and persons.  It ignores targets and serves as a
    reference point for the scorer, the checks and the reports.
    """
    heads = (
        with_class(persons)
        .groupBy(*CLASS)
        .agg(F.min(F.struct("worked_min", "person_id")).alias("head"))
        .select(*CLASS, F.col("head.person_id").alias("person_id"))
    )
    day = F.datediff("shift_date", F.lit("2000-01-03").cast("date"))
    turn = F.pmod(day * 31 + F.col("start_min") + F.col("person_id") * 17, F.lit(101))
    # Cost, turn and person as the digits of one number: its minimum is hashed, that of a struct would sort all candidates.
    person = F.col("person_id").cast("decimal(20,0)") + F.expr("9223372036854775808BD")
    digits = (
        F.col("cost").cast("decimal(15,0)") * F.expr("1" + "0" * 23 + "BD")
        + turn.cast("decimal(3,0)") * F.expr("1" + "0" * 20 + "BD")
        + person
    )
    chosen = F.pmod(F.col("best"), F.expr("1" + "0" * 20 + "BD")) - F.expr("9223372036854775808BD")
    return (
        cands.join(heads, CLASS)
        .groupBy(*SHIFT, "n_slots")
        .agg(F.min(digits).alias("best"))
        .select(
            *SHIFT,
            F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1)).alias("slot_nr"),
            chosen.cast("long").alias("person_id"),
        )
    )
