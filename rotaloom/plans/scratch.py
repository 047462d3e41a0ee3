"""Durable intermediate tables.

Long plans and iterative jobs cut their lineage by writing a Parquet table in
the folder that ``spark.checkpoint.dir`` names.  Such a table outlives lost
executors, is computed exactly once and brings real size statistics with it.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"


def folder(spark: SparkSession) -> str:
    """The shared scratch folder of this session.

    The cluster names it in ``spark.checkpoint.dir``.  Without that setting the
    session's warehouse is used, which must then be shared as well: a warehouse on
    a machine's own disk is refused unless the session runs on one machine.
    """
    configured = spark.conf.get(SETTING, None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get(WAREHOUSE).rstrip("/")
    if urlparse(warehouse).scheme in ("", "file") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a shared folder; the warehouse {warehouse} is on this machine's disk")
    return f"{warehouse}/_scratch"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back."""
    return Scratch(df.sparkSession).keep(df, label)


class Scratch:
    """Tables of one run; those that a later one supersedes can be removed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, label: str, slot: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
        """Write ``df`` and read it back; ``slot`` names what the table stands for, for ``remove``."""
        path = f"{folder(self.spark)}/rotaloom/{label}-{uuid.uuid4().hex}"
        df.write.options(**(options or {})).parquet(path)
        self.paths[slot or path] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame, slot: str) -> DataFrame:
        """Write the next version of a table and delete the one it supersedes."""
        old = self.paths.get(slot)
        new = self.keep(df, slot, slot)
        if old:
            self.paths["old"] = old
            self.remove("old")
        return new

    def remove(self, *slots: str) -> None:
        """Delete tables that nothing reads any more."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for slot in slots:
            path = self.paths.pop(slot, None)
            if path:
                place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(hadoop).delete(place, True)
