"""Time-of-day intervals as pairs of minute columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotaloom.rules import Rules


class Span(NamedTuple):
    """A closed interval in minutes of the day; values may exceed 1440 after midnight."""

    start: Column
    end: Column


def span(start: str | Column, end: str | Column) -> Span:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return Span(as_column(start), as_column(end))


def hull(a: Span, b: Span) -> Span:
    return Span(F.least(a.start, b.start), F.greatest(a.end, b.end))


def stretch(a: Span, point: Column) -> Span:
    return Span(F.least(a.start, point), F.greatest(a.end, point))


def duration(a: Span) -> Column:
    return a.end - a.start


def is_empty(a: Span) -> Column:
    return a.start.isNull() | a.end.isNull() | (a.end <= a.start)


def contains_point(a: Span, point: Column) -> Column:
    return point.between(a.start, a.end)


def contains(a: Span, b: Span) -> Column:
    return (a.start <= b.start) & (a.end >= b.end)


def intersects(a: Span, b: Span) -> Column:
    """Closed intersection: touching intervals count."""
    return (a.start <= b.end) & (b.start <= a.end)


def point_distance(a: Span, point: Column) -> Column:
    return F.greatest(F.lit(0), a.start - point, point - a.end)


def span_distance(a: Span, b: Span) -> Column:
    """Smaller distance from ``a`` to one of the two end points of ``b``."""
    return F.least(point_distance(a, b.start), point_distance(a, b.end))


def pad(a: Span, lead: Column | int, run_out: Column | int) -> Span:
    return Span(a.start - lead, a.end + run_out)


def blocked_window(start: Column, is_home: Column, rules: Rules) -> Span:
    """Window around a kick-off in which the team cannot work."""
    home, away = rules.block_home, rules.block_away
    return Span(
        start - F.when(is_home, home[0]).otherwise(away[0]),
        start + F.when(is_home, home[1]).otherwise(away[1]),
    )


def clock(minute: Column) -> Column:
    """``HH:mm`` of a minute of the day, wrapping at midnight (K4)."""
    wrapped = F.pmod(minute, F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(wrapped / 60), wrapped % 60)


def parse_clock(text: Column) -> Column:
    """Minute of the day of a strict ``HH:mm`` text, else null."""
    ok = text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    return F.when(ok, F.substring(text, 1, 2).cast("int") * 60 + F.substring(text, 4, 2).cast("int"))
