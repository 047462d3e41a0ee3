import datetime as dt

import pytest
from pyspark.sql import functions as F

from rotaloom.functions import dates as D
from rotaloom.functions import intervals as I
from rotaloom.operators.people import short_name


@pytest.mark.parametrize(
    "point, expected",
    [("12:00", 0), ("15:00", 0), ("13:00", 0), ("11:30", 30), ("08:40", 200), ("16:01", 61), ("15:01", 1)],
)
def test_point_distance(spark, point, expected):
    row = spark.range(1).select(I.point_distance(I.span(F.lit(720), F.lit(900)), I.parse_clock(F.lit(point))))
    assert row.first()[0] == expected


def test_span_distance_uses_end_points_only(spark):
    inner, outer = I.span(F.lit(700), F.lit(720)), I.span(F.lit(600), F.lit(900))
    assert spark.range(1).select(I.span_distance(inner, outer)).first()[0] == 100


def test_touching_spans_intersect(spark):
    a, b, c = (I.span(F.lit(s), F.lit(e)) for s, e in ((60, 120), (120, 180), (121, 130)))
    assert tuple(spark.range(1).select(I.intersects(a, b), I.intersects(a, c)).first()) == (True, False)


def test_empty_spans(spark):
    spans = [(10, 20), (10, 10), (20, 10), (None, 5)]
    df = spark.createDataFrame(spans, "s int, e int")
    assert [r[0] for r in df.select(I.is_empty(I.span("s", "e"))).collect()] == [False, True, True, True]


def test_clock_round_trip_and_wrap(spark):
    df = spark.createDataFrame([(0,), (605,), (1439,), (1470,)], "m int").select(I.clock(F.col("m")).alias("t"))
    assert [r[0] for r in df.collect()] == ["00:00", "10:05", "23:59", "00:30"]
    bad = spark.createDataFrame([("24:00",), ("9:00",), ("12:60",), ("",)], "t string")
    assert [r[0] for r in bad.select(I.parse_clock(F.col("t"))).collect()] == [None] * 4


def _step(d, n):
    moved, sign = 0, 1 if n > 0 else -1
    while moved < abs(n):
        d += dt.timedelta(days=sign)
        moved += d.weekday() < 5
    return d


def test_workdays_against_day_by_day_walk(spark):
    first = dt.date(1999, 12, 20)
    rows = [(first + dt.timedelta(days=i), n) for i in range(21) for n in range(-17, 18)]
    df = spark.createDataFrame(rows, "d date, n int").select("d", "n", D.add_workdays(F.col("d"), F.col("n")).alias("r"))
    assert all(r.r == _step(r.d, r.n) for r in df.collect())


def test_weekday_count_against_day_by_day_walk(spark):
    first = dt.date(2000, 2, 20)
    rows = [(first + dt.timedelta(days=i), first + dt.timedelta(days=j)) for i in range(25) for j in range(25)]
    df = spark.createDataFrame(rows, "a date, b date").select(
        "a", "b", D.weekday_count(F.col("a"), F.col("b")).alias("n")
    )
    for r in df.collect():
        days = [(r.a + dt.timedelta(days=k)).weekday() for k in range((r.b - r.a).days + 1)]
        assert r.n == (sum(w < 5 for w in days) if r.a <= r.b else -999)
    null = spark.range(1).select(D.weekday_count(F.lit(None).cast("date"), F.lit("2000-01-01").cast("date")))
    assert null.first()[0] == -999


def test_weekend_key_and_parsing(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, d),) for d in range(7, 11)], "d date")
    keys = [r[0] for r in df.select(D.weekend_key(F.col("d"))).collect()]
    assert keys == [None, dt.date(2000, 1, 7), dt.date(2000, 1, 7), None]
    row = spark.range(1).select(
        D.parse_german(F.lit("31.02.2000")),
        D.parse_short_german(F.lit("12.05.18")),
        D.parse_basic_iso(F.lit("20111203")),
        D.parse_basic_iso(F.lit("")),
        D.add_months(F.lit("2000-03-31").cast("date"), -1),
    ).first()
    assert tuple(row) == (None, dt.date(2018, 5, 12), dt.date(2011, 12, 3), None, dt.date(2000, 2, 29))


def test_short_name(spark):
    df = spark.createDataFrame([("Ann Alpha",), ("Ann",), ("Ann B. Cee",)], "n string")
    assert [r[0] for r in df.select(short_name(F.col("n"))).collect()] == ["AA", "Ann", "AB"]
