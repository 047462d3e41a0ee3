"""Text export of rosters and reports (K2, K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_lines(lines: DataFrame, order: list[str], path: str, charset: str = "UTF-8") -> None:
    """Write the ``line`` column in the given order, one folder per organisation.

    Rows are range-partitioned over the order, so part files taken by name give
    the whole text and no task holds an organisation by itself.  The layout is the
    same at every size.
    """
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        ordered.select("org_id", "line")
        .write.partitionBy("org_id")
        .option("encoding", charset)
        .option("sep", "\u0001")
        .option("quote", "")
        .option("escapeQuotes", "false")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


def write_roster(layout: DataFrame, path: str, charset: str = "UTF-8") -> None:
    write_lines(layout, ["org_id", "shift_date", "row_nr"], path, charset)


def write_stats(lines: DataFrame, path: str, charset: str = "UTF-8") -> None:
    write_lines(lines, ["org_id", "section", "line"], path, charset)


def write_table(df: DataFrame, path: str) -> None:
    """Columnar output clustered by organisation and day, the form later jobs should read."""
    keys = [c for c in ("org_id", "shift_date", "game_date") if c in df.columns]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
