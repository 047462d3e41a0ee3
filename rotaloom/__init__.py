"""rotaloom: duty-roster planning for sports clubs as Spark DataFrame operators."""

from rotaloom.rules import DutyRule, Rules, TeamRule

__all__ = ["DutyRule", "Rules", "TeamRule"]
