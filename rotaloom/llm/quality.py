"""Quality rules with adaptive thresholds.

Beside two fixed base rules a document is judged by how far it lies outside the bulk
of its own language and source.  Four integer measures are summarised by histogram
sketches: values up to 64 have a bucket each, larger ones share 32 buckets per power
of two, so quantiles are right within 1/32 and the number of buckets is bounded.
Such sketches merge by adding counts: those of a language and source merge into those
of the language, and these into one of everything.  A group's quantiles are blended
with those of its language, and these with those of everything, as if PRIOR documents
of the wider group belonged to it, at every size alike.  An upper bound lies FENCE times
as far above the 90th percentile as that lies above the median, and a lower bound mirrors it
at the 10th, so up to a tenth of a group may be bad without moving its bounds.  What happens
once in a text is chance: a single symbol, line or window that repeats is not counted.

Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.llm.common import WHITE, materialize, text_or_empty

SPLITTER = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
FENCE = 3
PRIOR = 100
SALTS = 8
# Measure: whether low values fail as well.
MEASURES = {"word_length": True, "symbols": False, "dup_lines": False, "repeats": False}
PERCENTS = (10, 50, 90)
# What a single symbol, line or three-word window found twice adds to a count.
ONCE = {"n_symbols": 1, "n_dup_lines": 1, "n_repeat_words": 6}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(column: str, characters: str) -> Column:
    return F.length(column) - F.length(F.translate(column, characters, ""))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts, n_lines and base_failed of every document.

    Null text counts as empty and has zero of everything.
    """
    trimmed = F.btrim("_text", F.lit(WHITE))
    rows = docs.select("doc_id", "lang", "source", text_or_empty().alias("_text"))
    rows = rows.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLITTER)))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    rows = rows.select(
        "doc_id", "lang", "source", "_words",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - _without("_text", WHITE)).cast("long").alias("word_chars"),
        _without("_text", SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    word = lambda i: F.get("_words", i)
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))
        ),
    )
    rows = rows.withColumn("_windows", windows)
    # Only texts that repeat a window at all are sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn(
        "_sorted",
        F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    neighbour = lambda i: F.get("_sorted", i)["h"]
    places = F.transform(
        "_sorted",
        lambda x, i: F.when(F.coalesce(x["h"] == neighbour(i - 1), F.lit(False)) | F.coalesce(x["h"] == neighbour(i + 1), F.lit(False)), x["i"]),
    )
    covered = F.flatten(F.transform(F.array_compact(places), lambda i: F.array(i, i + 1, i + 2)))
    rows = rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_sorted").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.withColumn("base_failed", failed)


def measures(rows: DataFrame) -> DataFrame:
    """The four integer measures of rows with features; null without words."""
    words, lines = F.nullif("n_words", F.lit(0)), F.nullif("n_lines", F.lit(0))
    more = lambda name: F.greatest(F.col(name) - ONCE[name], F.lit(0))
    per = {
        "word_length": F.floor(F.col("word_chars") * 100 / words),
        "symbols": F.floor(more("n_symbols") * 1000 / words),
        "dup_lines": F.floor(more("n_dup_lines") * 1000 / lines),
        "repeats": F.floor(more("n_repeat_words") * 1000 / words),
    }
    return rows.withColumns({f"m_{name}": value.cast("long") for name, value in per.items()})


def bucket(value: Column) -> Column:
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(shift * 32 + F.call_function("shiftright", value, shift)).cast("int")


def bucket_value(number: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.floor(number / 32) - 1
    top = F.call_function("shiftleft", (number - shift * 32 + 1).cast("long"), shift.cast("int")) - 1
    return F.when(number < 64, number.cast("long")).otherwise(top)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the rows that pass the base rules."""
    stacked = F.explode(
        F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(f"m_{m}")).alias("bucket")) for m in MEASURES])
    )
    good = rows.filter(~F.col("base_failed")).select("lang", "source", stacked.alias("x"))
    return good.groupBy("lang", "source", F.col("x.measure").alias("measure"), F.col("x.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` and measure: n, and the percentiles p10, p50 and p90 of the merged sketches."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys, "measure").orderBy("bucket")
    whole = Window.partitionBy(*keys, "measure")
    placed = merged.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(whole))
    at = lambda p: F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col("bucket")))
    found = placed.groupBy(*keys, "measure").agg(F.first("_all").alias("n"), *[at(p).alias(f"p{p}") for p in PERCENTS])
    return found.select(*keys, "measure", "n", *[bucket_value(F.col(f"p{p}")).alias(f"p{p}") for p in PERCENTS])


def thresholds(sketch: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group (lang, source) the bounds low_<measure> and high_<measure>, from the blended quantiles.

    A group none of whose documents pass the base rules takes the quantiles of its language, or of everything.
    """
    names = ["n", *[f"p{p}" for p in PERCENTS]]

    def wide(keys: list[str], level: int) -> DataFrame:
        out = _quantiles(sketch, keys).groupBy(*keys).pivot("measure", list(MEASURES)).agg(
            *[F.first(c).alias(c) for c in names]
        )
        per = [F.struct(*[F.col(f"{m}_{c}").alias(c) for c in names]).alias(m) for m in MEASURES]
        return out.select(*keys, F.struct(*per).alias(f"_level{level}"))

    own, lang = wide(["lang", "source"], 0), wide(["lang"], 1)
    # A few numbers for each measure, or nothing if no document passes the base rules.
    everything = {r["measure"]: r for r in _quantiles(sketch, []).collect()}
    g, o, l = groups.alias("g"), own.alias("o"), lang.alias("l")  # noqa: E741
    joined = g.join(
        o, F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")), "left"
    ).join(l, F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")

    def blended(name: str, quantile: str) -> Column:
        value = F.lit(everything[name][quantile] if name in everything else None).cast("long")
        for level in ("_level1", "_level0"):
            n = F.coalesce(F.col(f"{level}.{name}.n"), F.lit(0))
            part = F.coalesce(F.col(f"{level}.{name}.{quantile}"), F.lit(0)) * n
            value = F.call_function("div", part + value * PRIOR, n + PRIOR)
        return value

    bounds = []
    for name, both in MEASURES.items():
        p10, p50, p90 = (blended(name, f"p{p}") for p in PERCENTS)
        low = p10 - (p50 - p10) * FENCE if both else F.lit(0)
        high = p90 + (p90 - p50) * FENCE
        bounds += [low.cast("long").alias(f"low_{name}"), high.cast("long").alias(f"high_{name}")]
    return joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *bounds)


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and the bounds of its group.

    Null text counts as empty and fails.  A null language or source is a group like
    any other.  Repeated rows are judged each.  An empty table gives no rows; other
    columns are ignored.
    """
    rows = materialize(measures(features(docs)), "features")
    sketch = materialize(sketches(rows), "sketch")
    groups = rows.select("lang", "source").distinct()
    bounds = materialize(thresholds(sketch, groups), "thresholds")
    key = lambda t: t.select(
        "*", F.coalesce("lang", F.lit("")).alias("_l"), F.col("lang").isNull().alias("_ln"),
        F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_sn"),
    ).drop("lang", "source")
    salted = key(rows).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    spread = key(bounds).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    within = F.lit(True)
    for name in MEASURES:
        within &= F.coalesce(F.col(f"m_{name}").between(F.col(f"low_{name}"), F.col(f"high_{name}")), F.lit(False))
    told = salted.join(spread, ["_l", "_ln", "_s", "_sn", "_salt"], "left")
    kept = ~F.col("base_failed") & within
    limits = [f"{side}_{name}" for name, both in MEASURES.items() for side in (("low", "high") if both else ("high",))]
    return told.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), *limits)
