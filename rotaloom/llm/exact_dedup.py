"""Exact dedup by skew-safe combining.

Equal texts are combined in three steps, each grouping by the full text beside
its digest, so two texts with one digest never count as equal: every task
combines its own rows, the results of one digest are merged under a few salts,
and the salt winners are combined into the winner of all.  A text with a million
copies reaches the second step as one row per task and the third as one row per
salt.  Only digests with copies are joined back to the rows, again salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaloom.llm.common import materialize, text_or_empty

SALTS = 8


def sha256(column: str = "_text") -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def combined(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Distinct (_digest, _text) of ``rows`` (_id, _digest, _text): keep_id, group_size; dealt out by _digest."""
    winners = (
        rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_digest", "_salt", "_text")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return (
        winners.repartition("_digest")
        .groupBy("_digest", "_text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def repeated_digests(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Digests of more than one row: keep_id and group_size of the text, and how many texts share the digest."""
    return (
        combined(rows, salts)
        .groupBy("_digest")
        .agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.max("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
        )
        .filter("group_size > 1")
    )


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  The largest doc_id of equal texts stays; a null
    doc_id is smaller than all others.  Repeated rows (same doc_id, same text)
    each count and get the same answer.  An empty table gives no rows; all other
    columns are ignored.  ``digest`` replaces the digest that rows are dealt out
    by; whatever it is, texts are compared in full.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), text_or_empty().alias("_text")).withColumn(
        "_digest", sha256() if digest is None else digest
    )
    repeated = materialize(repeated_digests(rows, salts), "digests")
    clashing = repeated.filter("n_texts > 1").select("_digest")
    spread = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    light = rows.select(
        "_id", "_digest", sha256().alias("text_sha256"), F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt")
    )
    told = (
        light.join(spread, ["_digest", "_salt"], "left")
        .filter(F.coalesce("n_texts", F.lit(1)) == 1)
        .select(
            "_id",
            F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            "text_sha256",
        )
    )
    if not clashing.isEmpty():
        unclear = rows.join(clashing, "_digest", "left_semi")
        by_text = unclear.join(combined(unclear, salts), ["_digest", "_text"])
        told = told.unionByName(by_text.select("_id", "keep_id", "group_size", sha256().alias("text_sha256")))
    return told.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, one of equal texts, with all their columns.

    Null text counts as empty.  The largest doc_id stays, a null one last; among
    repeated rows with that doc_id the other columns settle which row speaks for
    them.  An empty table stays empty.
    """
    rest = F.struct(
        F.col("doc_id").isNotNull().alias("known"),
        F.col("doc_id").alias("id"),
        F.col("text").isNotNull().alias("has_text"),
        *[F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(docs.columns) if name not in ("doc_id", "text")],
    )
    rows = docs.select(text_or_empty().alias("_text"), rest.alias("_rest")).withColumn("_digest", sha256())
    local = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = local.groupBy("_digest", "_salt", "_text").agg(F.max("_rest").alias("_rest"))
    winners = winners.groupBy("_digest", "_text").agg(F.max("_rest").alias("_rest"))
    back = {"doc_id": F.col("_rest.id"), "text": F.when(F.col("_rest.has_text"), F.col("_text"))}
    return winners.select(
        *[back.get(name, F.col(f"_rest.c{i}")).alias(name) for i, name in enumerate(docs.columns)]
    )
