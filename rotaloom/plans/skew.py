"""Joins and rankings that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growing(df: DataFrame) -> DataFrame:
    """``df`` for a join whose two sides grow with the input: merged by key at any size.

    Files hold repeated keys in a small part of the bytes that rows take in memory, and an estimate scales those bytes by
    the widths of the columns.  It calls tables small that fill the driver once they are collected there.
    """
    return df.hint("merge")


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    spread_by: list[str],
    salts: int,
) -> DataFrame:
    """Join a possibly skewed ``big`` side with a few rows per key on the other side.

    Rows of one key on the big side go to ``salts`` different tasks; the small
    side is repeated once per salt, and its few rows per key grow with the keys, so it is never
    collected.  Valid for every join type that only keeps unmatched rows of the left (big) side.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(growing(right), [*on, "_salt"], how).drop("_salt")


def spread_row_number(
    df: DataFrame,
    keys: list[str],
    coarse: list[Column],
    tie: Column,
    fine: list[Column],
    name: str = "row_nr",
) -> DataFrame:
    """Exact 1..n numbering per key without putting a whole key into one task.

    The order is ``coarse`` values, then the bucket ``tie``, then ``fine``.  Rows
    are counted per (key, coarse, tie) with map-side partial counts, a running
    sum over those counts gives each bucket its offset, and only rows of the
    same bucket are sorted together.  ``coarse`` and ``tie`` must have a bounded
    number of values per key.
    """
    coarse_names = [f"_c{i}" for i in range(len(coarse))]
    bucketed = df.select("*", *[c.alias(n) for c, n in zip(coarse, coarse_names)], tie.alias("_tie"))
    bucket = [*keys, *coarse_names, "_tie"]
    running = Window.partitionBy(*keys).orderBy(*coarse_names, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy(*bucket).orderBy(*fine)
    return (
        bucketed.withColumn("_local", F.row_number().over(local))
        .join(growing(offsets), bucket)
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop(*coarse_names, "_tie", "_local", "_offset")
    )
