"""Whole-season plans: the operators wired together, lazily, for one set of rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from rotaloom.operators import assign as A
from rotaloom.operators import availability, candidates, feasible, people, report, score, shifts, targets
from rotaloom.plans.scratch import materialize
from rotaloom.rules import Rules


@dataclass
class Season:
    """Games and persons of any number of organisations, planned under one rule book.

    Stage tables that several later steps read (kick-offs, shifts, targets, workers, free
    candidates, costs, the plain roster, choices of single persons) are written once to the scratch folder,
    so they are computed once, have real size statistics and outlive lost
    executors; the other properties stay lazy.  In team mode representatives
    are planned, otherwise members who still owe time.
    """

    games: DataFrame
    persons: DataFrame
    rules: Rules = Rules()
    fixed: DataFrame | None = None

    @cached_property
    def members(self) -> DataFrame:
        return people.working_persons(self.persons, self.rules)

    @cached_property
    def kickoffs(self) -> DataFrame:
        return materialize(shifts.kickoffs(self.games), "kickoffs")

    @cached_property
    def shifts(self) -> DataFrame:
        return materialize(shifts.all_shifts(self.kickoffs, self.rules), "shifts")

    @cached_property
    def headcounts(self) -> DataFrame:
        return people.headcounts(self.members, self.rules)

    @cached_property
    def planned(self) -> DataFrame:
        return targets.planned_minutes(self.shifts)

    @cached_property
    def targets(self) -> DataFrame:
        return materialize(targets.target_minutes(self.headcounts, self.planned, self.rules), "targets")

    @cached_property
    def workers(self) -> DataFrame:
        planned = people.workers(self.persons, self.rules)
        if not self.rules.team_mode:
            planned = people.unfinished_persons(planned, self.targets, self.rules)
        return materialize(planned, "workers")

    @cached_property
    def windows(self) -> DataFrame:
        return availability.team_windows(self.kickoffs, self.rules)

    @cached_property
    def candidates(self) -> DataFrame:
        return materialize(
            candidates.candidates(self.shifts, self.workers, self.windows, self.rules), "candidates"
        )

    @cached_property
    def fixed_merge(self) -> tuple[DataFrame, DataFrame]:
        return candidates.merge_fixed(self.fixed, self.candidates, self.workers, self.rules)

    @cached_property
    def costs(self) -> DataFrame:
        return materialize(candidates.proximity_costs(self.shifts, self.kickoffs, self.rules), "costs")

    @cached_property
    def free(self) -> DataFrame:
        """Candidates after the weekend rule, with their proximity cost."""
        kept = candidates.free_candidates(self.candidates, self.kickoffs)
        return materialize(candidates.with_cost(kept, self.costs, self.rules), "free")

    @cached_property
    def pairs(self) -> DataFrame:
        """One row per (shift, slot, person) that may be chosen."""
        return materialize(candidates.expand(self.free, self.workers, self.rules), "pairs")

    @cached_property
    def uncovered(self) -> DataFrame:
        return candidates.uncovered_shifts(self.shifts, self.free)

    @cached_property
    def impossible(self) -> DataFrame:
        """Witnesses of moments that cannot be filled; none in team mode, where a representative stands for a team."""
        found = feasible.impossible_moments(self.free)
        return found.limit(0) if self.rules.team_mode else materialize(found, "impossible")

    @cached_property
    def active(self) -> DataFrame:
        return materialize(score.active_workers(self.workers, self.free, self.targets, self.rules), "active")

    @cached_property
    def fixed_rows(self) -> DataFrame | None:
        """Fixed assignments that could be resolved, one per slot."""
        return None if self.fixed is None else materialize(self.fixed_merge[0], "fixed")

    def assign(self, on_uncovered: str = "report", require_complete: bool = False, **options) -> A.Assignment:
        """Fill the roster.  ``on_uncovered='fail'`` stops if a shift has no candidate, and
        ``require_complete`` if a slot stays open."""
        candidates.uncovered_shifts(self.shifts, self.free, on_uncovered)
        run = A.assign(self.free, self.active, self.rules, fixed=self.fixed_rows, **options)
        return run.require_complete() if require_complete else run

    def violations(self, roster: DataFrame) -> DataFrame:
        """Broken rules of a roster; fixed rows may use candidates that the weekend rule removes."""
        return score.violations(roster, self.active, self.free, self.rules, self.fixed_rows, self.candidates)

    @cached_property
    def simple_roster(self) -> DataFrame:
        return materialize(A.one_pass_roster(self.free, self.workers, self.rules), "roster")

    def full(self, roster: DataFrame) -> DataFrame:
        return report.with_parents(roster, self.shifts, self.rules)

    @cached_property
    def people(self) -> DataFrame:
        return report.roster_persons(self.workers, self.shifts, self.rules)
