"""Rule book of a season: team and duty dimensions plus scalar parameters.

Everything here is a bounded, driver-side constant.  Flags become ``isin``
expressions and per-duty numbers become ``CASE`` expressions, so most lookups
cost neither a join nor a shuffle.  Only the team dimension is ever joined; the
optimiser sees its size and decides how.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_END = 1440

SALES = "Verkauf"
CASH = "Kasse"
SUPERVISION = "Aufsicht"
WIPING = "Wischen"

SUPERVISOR_TEAM = "Aufsicht"
NO_TEAM = "None"


@dataclass(frozen=True)
class TeamRule:
    code: str
    capacity: float
    work_from: int
    work_to: int
    has_cash: bool = False
    has_wiper: bool = False
    parent_duty: bool = False
    wiper_duty: bool = False
    is_youth: bool = False
    is_active: bool = False


@dataclass(frozen=True)
class DutyRule:
    duty_type: str
    short: str
    n_people: int
    lead_min: int
    run_out_min: int
    lengths_hh: tuple[int, ...]


# Duty types (name, letter, people, lead-in, run-out, lengths in half-hours).
DUTIES = (
    DutyRule(SALES, "V", 2, 60, 120, (5, 6, 7, 8)),
    DutyRule(CASH, "K", 1, 60, 30, (3, 4, 5, 6)),
    DutyRule(SUPERVISION, "A", 1, 60, 180, (6, 7, 8, 9, 10)),
    DutyRule(WIPING, "W", 2, 15, 15, (3,)),
)

# Teams with capacity, first and latest working minute and flags.  A latest
# minute of 1440 means all day, 0 means the team never works.
TEAMS = (
    TeamRule("M1", 1.00, 0, 1440, has_cash=True, is_active=True),
    TeamRule("M2", 1.00, 0, 1440, is_active=True),
    TeamRule("M3", 1.00, 0, 1440, is_active=True),
    TeamRule("M4", 1.00, 0, 1440, is_active=True),
    TeamRule("F1", 1.00, 0, 1440, has_cash=True, has_wiper=True, is_active=True),
    TeamRule("F2", 1.00, 0, 1440, has_cash=True, is_active=True),
    TeamRule("F3", 1.00, 0, 1440, is_active=True),
    TeamRule("mA1", 0.85, 0, 1200, is_youth=True),
    TeamRule("mA2", 0.85, 0, 1200, is_youth=True),
    TeamRule("wA1", 0.85, 0, 1200, is_youth=True),
    TeamRule("wA2", 0.85, 0, 1200, is_youth=True),
    TeamRule("mB1", 0.75, 0, 1080, is_youth=True),
    TeamRule("mB2", 0.75, 0, 1080, is_youth=True),
    TeamRule("wB1", 0.75, 0, 1080, is_youth=True),
    TeamRule("wB2", 0.75, 0, 1080, is_youth=True),
    TeamRule("mC1", 0.31, 0, 1200, parent_duty=True, wiper_duty=True, is_youth=True),
    TeamRule("wC1", 0.31, 0, 1200, parent_duty=True, wiper_duty=True, is_youth=True),
    TeamRule("mC2", 0.75, 0, 1200, parent_duty=True, wiper_duty=True, is_youth=True),
    TeamRule("wC2", 0.75, 0, 1200, parent_duty=True, wiper_duty=True, is_youth=True),
    TeamRule("gD1", 0.00, 0, 0, parent_duty=True, is_youth=True),
    TeamRule("wD1", 0.00, 0, 0, parent_duty=True, is_youth=True),
    TeamRule("gD2", 0.00, 0, 0, parent_duty=True, is_youth=True),
    TeamRule("wD2", 0.00, 0, 0, parent_duty=True, is_youth=True),
    TeamRule("gE1", 0.00, 0, 0, parent_duty=True, is_youth=True),
    TeamRule("gE2", 0.00, 0, 0, parent_duty=True, is_youth=True),
    TeamRule("wE1", 0.00, 0, 0, parent_duty=True, is_youth=True),
    TeamRule("wE2", 0.00, 0, 0, parent_duty=True, is_youth=True),
    TeamRule("gF1", 0.00, 0, 0, parent_duty=True, is_youth=True),
    TeamRule("gF2", 0.00, 0, 0, parent_duty=True, is_youth=True),
    TeamRule("gF3", 0.00, 0, 0, is_youth=True),
    TeamRule("Minis", 0.00, 0, 0, is_active=True),
    TeamRule("Aufsicht", 1.00, 0, 1440),
    TeamRule("None", 1.00, 0, 1440, is_youth=True),
)


@dataclass(frozen=True)
class Rules:
    """All parameters of one planning run."""

    teams: tuple[TeamRule, ...] = TEAMS
    duties: tuple[DutyRule, ...] = DUTIES
    team_mode: bool = True
    early_team: str = "F1"
    early_min: int = 30
    min_youth_size: int = 10
    parent_lead_min: int = 60
    parent_handover_min: int = 30
    parent_run_out_min: int = 60
    wiper_min: int = 60
    min_shift_min: int = 60
    block_home: tuple[int, int] = (60, 120)
    block_away: tuple[int, int] = (120, 180)
    near_game_min: int = 60
    flat_cost: int = 90
    over_penalty: int = 5
    under_penalty: int = 1
    night_until_min: int = 240
    salts: int = 16
    _index: dict = field(init=False, repr=False, compare=False, hash=False, default=None)

    def __post_init__(self):
        codes = [t.code for t in self.teams]
        if len(set(codes)) != len(codes):
            raise ValueError("team codes must be unique")
        object.__setattr__(self, "_index", {t.code: i for i, t in enumerate(self.teams)})

    def with_(self, **changes) -> "Rules":
        return replace(self, **changes)

    # -- scalars -----------------------------------------------------------
    def duty(self, duty_type: str) -> DutyRule:
        return next(d for d in self.duties if d.duty_type == duty_type)

    @property
    def finished_slack_min(self) -> int:
        """Half of the shortest possible shift, in whole minutes (P10)."""
        return min(d.lengths_hh[0] for d in self.duties) * 30 // 2

    @property
    def helper_columns(self) -> int:
        """Helper cells of a roster line: six, or more if a duty takes more people."""
        return max(6, *(d.n_people for d in self.duties))

    def codes(self, flag: str) -> list[str]:
        return [t.code for t in self.teams if getattr(t, flag)]

    @property
    def working_codes(self) -> list[str]:
        return [t.code for t in self.teams if t.work_to > t.work_from]

    # -- column expressions ------------------------------------------------
    def has_flag(self, team: Column, flag: str) -> Column:
        return team.isin(self.codes(flag))

    def may_work(self, team: Column, is_supervisor: Column) -> Column:
        """P5: the team has a working window, or the person is a supervisor."""
        return team.isin(self.working_codes) | is_supervisor

    def duty_value(self, duty_type: Column, attribute: str) -> Column:
        """CASE over the duty types giving one attribute of the dimension."""
        expr = None
        for d in self.duties:
            value = getattr(d, attribute)
            value = F.array(*map(F.lit, value)) if isinstance(value, tuple) else F.lit(value)
            branch = duty_type == d.duty_type
            expr = F.when(branch, value) if expr is None else expr.when(branch, value)
        return expr

    def team_index(self, team: Column) -> Column:
        codes = F.array(*[F.lit(t.code) for t in self.teams])
        return F.array_position(codes, team).cast("int") - 1

    # -- dimension tables --------------------------------------------------
    def dim_team(self, spark: SparkSession) -> DataFrame:
        """Team dimension, one row per code."""
        flags = ["has_cash", "has_wiper", "parent_duty", "wiper_duty", "is_youth", "is_active"]
        rows = ",".join(
            "({}, '{}', {}D, {}, {}, {})".format(
                i,
                t.code.replace("'", "''"),
                t.capacity,
                t.work_from,
                t.work_to,
                ", ".join(str(getattr(t, f)).lower() for f in flags),
            )
            for i, t in enumerate(self.teams)
        )
        names = ", ".join(["team_idx", "team_code", "capacity", "work_from", "work_to", *flags])
        return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")

    def dim_duty_type(self, spark: SparkSession) -> DataFrame:
        rows = ",".join(
            "('{}', '{}', {}, {}, {}, array({}))".format(
                d.duty_type, d.short, d.n_people, d.lead_min, d.run_out_min, ", ".join(map(str, d.lengths_hh))
            )
            for d in self.duties
        )
        return spark.sql(
            f"SELECT * FROM VALUES {rows} AS t(duty_type, short, n_people, lead_min, run_out_min, lengths_hh)"
        )
