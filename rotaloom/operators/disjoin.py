"""Elementary intervals of overlapping ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.plans.skew import growing


def elementary_intervals(df: DataFrame, keys: list[str], start: str = "start_min", end: str = "end_min") -> DataFrame:
    """Consecutive pieces between all distinct end points of a key.

    End points are made distinct first, so a key never holds more points than
    there are minutes, however many ranges it has.
    """
    points = df.select(*keys, F.explode(F.array(start, end)).alias("piece_start")).distinct()
    following = F.lead("piece_start").over(Window.partitionBy(*keys).orderBy("piece_start"))
    return points.withColumn("piece_end", following).filter("piece_end is not null")


def disjoin(df: DataFrame, keys: list[str], start: str = "start_min", end: str = "end_min") -> DataFrame:
    """Each elementary interval with every range that covers it; gaps drop out."""
    pieces = elementary_intervals(df, keys, start, end)
    covers = (F.col(start) <= F.col("piece_start")) & (F.col(end) >= F.col("piece_end"))
    return df.join(growing(pieces), keys).filter(covers)


def coverage(df: DataFrame, keys: list[str], start: str = "start_min", end: str = "end_min") -> DataFrame:
    """Number of ranges over each elementary interval, as a running sum of starts minus ends.

    Ranges are first counted per end point, so nothing grows with the overlaps.
    """
    steps = (
        df.filter(F.col(end) > F.col(start))
        .select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.col(start).alias("p"), F.lit(1).alias("d")),
                    F.struct(F.col(end).alias("p"), F.lit(-1).alias("d")),
                )
            ).alias("s"),
        )
        .groupBy(*keys, F.col("s.p").alias("piece_start"))
        .agg(F.sum("s.d").alias("d"))
    )
    in_order = Window.partitionBy(*keys).orderBy("piece_start")
    return (
        steps.select(
            *keys,
            "piece_start",
            F.lead("piece_start").over(in_order).alias("piece_end"),
            F.sum("d").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("n_covering"),
        )
        .filter("piece_end is not null and n_covering > 0")
    )
