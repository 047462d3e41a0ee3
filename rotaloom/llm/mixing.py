"""Mixing sources to target weights by a time-varying curriculum.

Each source has a schedule: its share of the stream at training time t in [0, 1]
is (1 + s(2t - 1)) times its mean share, with a slope s between -1 and 1.  The
integral of that schedule is the source's cumulative token demand; inverting it
at a document's first word gives the document's training position, and sorting by
position deals the documents out.  Documents of a source queue in the order of a
keyed digest, once per pass, so runs agree.

Running sums are two-level: sums of small digest ranges, a running sum over those
ranges, and one inside each range.  The number of ranges follows the size of the
source, so no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.llm.common import materialize, text_or_empty

WEIGHTS = (3, 1, 2)
SLOPES = (0.5, 0.0, -0.5)
VOLUME_NUM, VOLUME_DEN = 3, 2
MOST_PASSES = 2
ROWS_PER_RANGE = 1_000
SALTS = 8
SEED = "mix"


def n_words(column: str = "text") -> Column:
    """Number of words; null has none."""
    return F.regexp_count(text_or_empty(column), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, n_docs, source_nr, target.

    The volume is shared by weight; no target passes MOST_PASSES times its source's
    size, and what is cut off is shared again.  Sorted by how early a source is
    full, the level at which the rest of the volume runs out has a closed form.
    """
    sizes = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("source_nr", F.lit(len(weights))) + 1).cast("int"))
    sizes = sizes.withColumn("source_nr", (F.row_number().over(by_name) - 1).cast("long")).withColumn(
        "weight", weight.cast("long")
    )
    full = F.col("source_size") * MOST_PASSES
    ratio = full / F.col("weight")
    ordered = Window.orderBy(ratio, "source_nr")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    volume = F.sum("source_size").over(Window.partitionBy()) * VOLUME_NUM / F.lit(VOLUME_DEN)
    left = volume - F.coalesce(F.sum(full).over(before), F.lit(0))
    weight_left = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    level = left / weight_left
    staged = sizes.withColumn("_ratio", ratio).withColumn("_level", level)
    # The level of the first source that is not full holds for all later ones.
    open_level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(Window.partitionBy())
    first_open = F.coalesce(open_level, F.col("_ratio"))
    return staged.withColumn("_first", first_open).select(
        "source",
        "source_size",
        "n_docs",
        "source_nr",
        F.least(full.cast("double"), F.col("weight") * F.col("_first")).alias("target"),
    )


def _keyed(table: DataFrame) -> DataFrame:
    """The source as two columns that compare equal for null as well."""
    return table.withColumn("_no_source", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken and position.

    ``copies`` says how often the whole document is taken (0 to MOST_PASSES),
    ``taken`` how many words that makes, ``position`` where in [0, 1] its first copy
    stands (null if it is not taken) and ``positions`` where all of them do.  A
    document without words is taken like others and adds nothing.  Null sources form
    one source, the last.  Repeated rows queue one after the other.  An empty table
    gives no rows.  All other columns pass through; a column of ``docs`` with one of
    these names, or with one of the helper names that start with an underscore, gives
    way to the new one.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = _keyed(docs.withColumn("size", n_words())).withColumn("_key", digest)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    goals = materialize(targets(rows), "targets")
    spread = _keyed(goals).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("source")
    overlap = [c for c in ("source_size", "n_docs", "source_nr", "target") if c in rows.columns]
    rows = rows.drop(*overlap).join(spread, ["_source", "_no_source", "_salt"])
    # Equal steps through the first 32 bits of the digest, so many that a range holds about ROWS_PER_RANGE rows.
    ranges = F.ceil(F.col("n_docs") / ROWS_PER_RANGE)
    first_bits = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_range", F.shiftright(first_bits * ranges, 32))
    key = ["source_nr", "_range"]
    up_to = Window.partitionBy("source_nr").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key).agg(F.sum("size").alias("_sum")).select(
        *key, F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_offset")
    )
    queue = Window.partitionBy(*key).orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(queue), F.lit(0))).join(offsets, key)
    rows = rows.withColumn("_before", F.col("_before") + F.col("_offset"))

    size, source_size, target, before = (F.col(c) for c in ("size", "source_size", "target", "_before"))
    passes = F.coalesce(F.floor(target / F.nullif(source_size, F.lit(0))), F.lit(0))
    rows = rows.withColumn("_passes", passes)
    rest = target - F.col("_passes") * source_size
    copies = F.col("_passes") + F.when(before * 2 + size < rest * 2, 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * size)
    slope = F.element_at(F.array(*[F.lit(s) for s in SLOPES]), (F.pmod("source_nr", F.lit(len(SLOPES))) + 1).cast("int"))
    rows = rows.withColumn("_slope", slope)
    demand = lambda nr: F.coalesce((nr * source_size + before) / F.nullif(target, F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn(
        "positions",
        F.when(
            F.col("copies") > 0,
            F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda nr: inverse_demand(demand(nr), F.col("_slope"))),
        ).otherwise(F.array().cast("array<double>")),
    ).withColumn("position", F.try_element_at("positions", F.lit(1)))
    added = ["size", "source_size", "target", "copies", "taken", "position", "positions"]
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *added)


def inverse_demand(share: Column, slope: Column) -> Column:
    """The time at which a source has had ``share`` of its words, with the demand (1 - s)t + st^2."""
    curved = (F.sqrt((1 - slope) * (1 - slope) + slope * share * 4) - (1 - slope)) / (slope * 2)
    return F.least(F.lit(1.0), F.when(slope == 0, share).otherwise(curved))


def ordered(planned: DataFrame) -> DataFrame:
    """Rows of a ``plan`` once per copy, range-sorted by training position; ``position`` is that of the copy."""
    names = [c for c in planned.columns if c not in ("position", "positions")]
    copies = planned.select(*[F.col(f"`{c}`") for c in names], F.explode("positions").alias("position"))
    return copies.orderBy("position", "doc_id")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed stream: one row per copy, in the columns of ``docs`` and ``position``, range-sorted by position."""
    names = [c for c in docs.columns if c != "position"]
    return ordered(plan(docs, seed)).select(*[F.col(f"`{c}`") for c in names], "position")


def shares(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per document what the mixed stream holds of it: doc_id, size, source_size, target, taken, position.

    The stream is written in its order and read back; ``taken`` adds up the copies found there and
    ``position`` is that of the first one.  Texts are left out, since nothing here needs them.
    """
    facts = ["doc_id", "size", "source_size", "target"]
    planned = materialize(plan(docs, seed).select(*facts, "copies", "positions"), "plan")
    # The number tells repeated rows apart.
    rows = planned.filter("copies > 0").withColumn("_row", F.monotonically_increasing_id())
    stream = materialize(ordered(rows), "stream")
    taken = stream.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in facts], F.sum("size").alias("taken"), F.min("position").alias("position")
    )
    none = planned.filter("copies = 0").select(*facts, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("double").alias("position"))
    return taken.select(*facts, "taken", "position").unionByName(none)
