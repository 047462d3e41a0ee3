"""Personal data found by rules and by weakly supervised labelers.

Four kinds (email, ip, card, phone) follow fixed rules and always count.  Further
spans, of the kinds ``id`` (national and bank numbers) and ``secret`` (keys, tokens),
start as candidates: runs of letters, digits and a few marks that hold a digit and are
long enough.  Three labelers vote on each: a strict pattern, a gazetteer of prefixes,
and the words before it.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and so how likely each pattern is a hit; naive
Bayes on the span's own shape, fitted to those soft labels over all candidates, makes
the final decision.  A candidate that overlaps a rule's span is dropped.

Everything is DataFrame code.  Patterns use single-character loops only, so long runs
neither backtrack nor recurse: where a rule repeats a group, marks that cannot take
part are first replaced by a neutral character of the same length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.llm.common import materialize, text_or_empty

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "id", "secret"]
EM_ROUNDS = 30
ACCEPT = 0.5
CONTEXT_CHARS = 32
MIN_CANDIDATE = 8
SPANS = "array<struct<s:int,e:int,m:string,b:string>>"

# Prefixes of well-known credentials and numbers, and words that announce such values.
PREFIXES = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|sk-|sk_|pk_|xox[abp]-|eyJ|glpat-|SG\.|ya29\.|DE[0-9]{2}|FR[0-9]{2}|ES[0-9]{2}|GB[0-9]{2})"
WORDS = (
    r"(?i)(?:token|secret|api[ _-]?key|key|password|passwd|pwd|bearer|auth|credential|iban|ssn|social security|"
    r"passport|account|konto|compte|cuenta|ausweis|dni|tax id|steuer)[^\p{L}\p{N}]{0,6}$"
)
STRICT_SECRET = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})$"
STRICT_ID = r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{8}[A-Z])$"


def _running(values: Column, join: Callable[[Column, Column], Column], rest: Callable[[Column], Column]) -> Column:
    """``rest`` of the running ``join`` (sum, largest) of an array, by doubling steps: n log n in its length."""
    steps = F.sequence(F.lit(1), F.greatest(F.length(F.bin(F.size(values))), F.lit(1)))
    reach = lambda k: F.call_function("shiftleft", F.lit(1), k - 1)
    step = lambda acc, k: F.transform(
        acc, lambda x, i: F.when(i >= reach(k), join(x, F.get(acc, i - reach(k)))).otherwise(x)
    )
    return F.aggregate(steps, values, step, rest)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, b>>: where ``pattern`` matches, in code points, end exclusive.

    ``m`` is the match and ``b`` the end, at most CONTEXT_CHARS long, of the match before it and what stands between.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    matches = F.filter(F.arrays_zip(found.alias("m"), between.alias("b")), lambda x: x["m"].isNotNull())

    def placed(rows: Column) -> Column:
        lengths = F.transform(rows, lambda x: F.length(x["b"]) + F.length(x["m"]))

        def span(x: Column, end: Column, i: Column) -> Column:
            last = F.right(F.coalesce(F.get(rows, i - 1)["m"], F.lit("")), F.lit(CONTEXT_CHARS))
            before = F.right(F.concat(last, F.right(x["b"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
            return F.struct(
                (end - F.length(x["m"])).alias("s"), end.alias("e"), x["m"].alias("m"), before.alias("b")
            )

        return _running(lengths, lambda x, y: x + y, lambda ends: F.transform(rows, lambda x, i: span(x, F.get(ends, i), i)))

    return _with(matches, placed)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    doubled = F.transform(
        from_right,
        lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)),
    )
    return F.aggregate(F.filter(doubled, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _base(text: Column) -> dict[str, Column]:
    """The spans of each kind that its rule accepts."""
    none = F.array().cast(SPANS)
    # A dot of a domain stands between two domain characters; any other counts as a local character only.
    dotted = F.regexp_replace(text, r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", "%")
    email = _spans(
        dotted, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
    )
    ip = F.filter(
        _spans(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        lambda x: F.forall(
            F.transform(F.split(x["m"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")),
            lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")),
        ),
    )
    # A separator of a card number stands between two digits.
    joined = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "x")
    card = F.filter(
        _spans(joined, r"[0-9][0-9\x20-]++"),
        lambda x: F.length(_digits(x["m"])).between(13, 19) & _luhn(_digits(x["m"])),
    )
    phone = F.filter(_spans(text, r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: F.length(_digits(x["m"])).between(9, 15))
    has = lambda mark: F.instr(text, mark) > 0
    digit = text.rlike("[0-9]")
    return {
        "email": F.when(has("@"), email).otherwise(none),
        "ip": F.when(has(".") & digit, ip).otherwise(none),
        "card": F.when(digit, card).otherwise(none),
        "phone": F.when(has("+") & digit, phone).otherwise(none),
    }


def _votes(x: Column) -> Column:
    """A candidate with its kind, votes (1, 0 or null for abstaining) and shape."""
    m, before = x["m"], x["b"]
    upper, lower = F.length(F.regexp_replace(m, "[^A-Z]", "")), F.length(F.regexp_replace(m, "[^a-z]", ""))
    digits = F.length(_digits(m))
    strict = m.rlike(STRICT_SECRET) | m.rlike(STRICT_ID)
    named = m.rlike(PREFIXES)
    announced = before.rlike(WORDS)
    number = m.rlike(STRICT_ID) | ((upper + lower <= 6) & ~m.rlike(STRICT_SECRET) & (digits * 2 > F.length(m)))
    share = lambda n: F.floor(n * 4 / F.length(m)).cast("string")
    return F.struct(
        x["s"].alias("s"),
        x["e"].alias("e"),
        F.when(number, "id").otherwise("secret").alias("kind"),
        strict.cast("int").alias("v1"),
        F.when(named, 1).cast("int").alias("v2"),
        F.when(announced, 1).when(before.rlike(r"\p{L}{2,}[,.]?\s$"), 0).cast("int").alias("v3"),
        F.array(
            F.concat(F.lit("length "), F.least(F.floor(F.length(m) / 4), F.lit(20)).cast("string")),
            F.concat(F.lit("upper "), share(upper)),
            F.concat(F.lit("lower "), share(lower)),
            F.concat(F.lit("digits "), share(digits)),
            F.concat(F.lit("marks "), F.least(F.length(m) - upper - lower - digits, F.lit(4)).cast("string")),
            F.concat(F.lit("quoted "), F.right(before, F.lit(1)).isin('"', "'").cast("string")),
        ).alias("features"),
    )


def _candidates(text: Column, base: list[Column]) -> Column:
    """Runs that might be an id or a secret and overlap no span of a rule."""
    # Only whole runs that are long enough and hold a digit match, so ordinary words cost no array work.
    run = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{%d})(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]++" % MIN_CANDIDATE
    # Sorted by a span's start and a run's end, a run is free if no span before it ends behind the run's start.
    taken = F.transform(
        F.concat(*base),
        lambda x: F.struct(
            x["s"].alias("k"), F.lit(1).alias("rule"), x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m"), F.lit("").alias("b")
        ),
    )
    runs = F.transform(
        _spans(text, run),
        lambda x: F.struct(
            x["e"].alias("k"), F.lit(0).alias("rule"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["b"].alias("b")
        ),
    )

    def unmet(rows: Column) -> Column:
        ends = F.transform(rows, lambda x: F.when(x["rule"] == 1, x["e"]).otherwise(0))
        clear = lambda upto: F.filter(rows, lambda x, i: (x["rule"] == 0) & (F.get(upto, i) <= x["s"]))
        kept = lambda upto: F.transform(
            clear(upto), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["b"].alias("b"))
        )
        return _running(ends, F.greatest, kept)

    free = _with(F.sort_array(F.concat(taken, runs)), unmet)
    none = F.array().cast(SPANS)
    return F.when(text.rlike("[0-9]"), free).otherwise(none)


EM = """
aggregate(
  sequence(1, {rounds}),
  named_struct('p', 0.5D, 'a', array(0.9D, 0.9D, 0.8D), 'b', array(0.9D, 0.9D, 0.8D)),
  (m, r) -> aggregate(
    transform(votes, v -> named_struct('v', v, 'w', {posterior})),
    named_struct('n', 0D, 'w', 0D, 'hit', array(1D, 1D, 1D), 'all1', array(2D, 2D, 2D), 'miss', array(1D, 1D, 1D), 'all0', array(2D, 2D, 2D)),
    (t, x) -> named_struct(
      'n', t.n + x.v.n, 'w', t.w + x.w * x.v.n,
      'hit', transform(t.hit, (y, j) -> y + coalesce(if(x.v.v[j] = 1, x.w * x.v.n, 0D), 0D)),
      'all1', transform(t.all1, (y, j) -> y + coalesce(if(x.v.v[j] is not null, x.w * x.v.n, 0D), 0D)),
      'miss', transform(t.miss, (y, j) -> y + coalesce(if(x.v.v[j] = 0, (1 - x.w) * x.v.n, 0D), 0D)),
      'all0', transform(t.all0, (y, j) -> y + coalesce(if(x.v.v[j] is not null, (1 - x.w) * x.v.n, 0D), 0D))),
    t -> named_struct(
      'p', least(greatest((t.w + 1) / (t.n + 2), 0.001D), 0.999D),
      'a', transform(t.hit, (y, j) -> least(greatest(y / t.all1[j], 0.5D), 0.99D)),
      'b', transform(t.miss, (y, j) -> least(greatest(y / t.all0[j], 0.5D), 0.99D)))))
"""
# Likelihood of a vote pattern v under the model m if the span is a hit, and if it is not.
YES = "aggregate(sequence(0, 2), m.p, (q, j) -> q * case when v.v[j] = 1 then m.a[j] when v.v[j] = 0 then 1 - m.a[j] else 1D end)"
NO = "aggregate(sequence(0, 2), 1 - m.p, (q, j) -> q * case when v.v[j] = 0 then m.b[j] when v.v[j] = 1 then 1 - m.b[j] else 1D end)"
POSTERIOR = f"({YES}) / (({YES}) + ({NO}))"


def reliabilities(counts: DataFrame) -> DataFrame:
    """One row with the EM model (p, a, b) of vote patterns (v, n), at most 27 of them."""
    rows = counts.agg(F.sort_array(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("votes"))
    return rows.select("votes", F.expr(EM.format(rounds=EM_ROUNDS, posterior=POSTERIOR)).alias("m"))


def pattern_probabilities(counts: DataFrame) -> DataFrame:
    """(v, p): how likely a span with the vote pattern is a hit."""
    return reliabilities(counts).select("m", F.explode("votes").alias("v")).select("v.v", F.expr(POSTERIOR).alias("p"))


def _accepted(candidates: DataFrame) -> DataFrame:
    """Rows (_row, s, e, kind) of ``candidates`` that the classifier accepts."""
    votes = F.array("v1", "v2", "v3").alias("v")
    pattern = lambda v: F.concat_ws(",", F.transform(v, lambda x: F.coalesce(x.cast("string"), F.lit("-"))))
    keyed = candidates.withColumn("_pattern", pattern(F.array("v1", "v2", "v3")))
    counts = keyed.groupBy(votes).agg(F.count(F.lit(1)).alias("n"))
    soft = pattern_probabilities(counts).select(pattern(F.col("v")).alias("_pattern"), "p")
    labelled = keyed.join(F.broadcast(soft), "_pattern")  # at most 27 rows

    # Naive Bayes: soft counts of every feature value; their number is bounded by the buckets.
    values = labelled.select("p", F.explode("features").alias("value"))
    counts_of = values.groupBy("value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    # Every candidate has one value of each feature, so a feature's counts add up to all candidates.
    feature = Window.partitionBy(F.split("value", " ")[0])
    odds_of = lambda n: F.log((F.col(n) + 1) / (F.sum(n).over(feature) + 2))
    weights = counts_of.select("value", (odds_of("yes") - odds_of("no")).alias("weight"))
    scored = (
        labelled.select("_row", "s", "e", "kind", "p", F.explode("features").alias("value"))
        .join(F.broadcast(weights), "value")  # at most 21 + 3 * 5 + 5 + 2 values
        .groupBy("_row", "s", "e", "kind", "p")
        .agg(F.sum("weight").alias("shape"))
    )
    odds = F.log(F.col("p") / (1 - F.col("p"))) + F.col("shape")
    return scored.filter(1 / (1 + F.exp(-odds)) > ACCEPT).select("_row", "s", "e", "kind")


def _joined(kinds: dict[str, Column]) -> Column:
    """kind:start:end of the spans, by kind as listed, then start, comma-joined."""
    def named(kind: str, spans: Column) -> Column:
        return F.transform(
            spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
        )

    parts = [named(kind, spans) for kind, spans in kinds.items()]
    return F.array_join(F.concat(*parts), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the four counts, base_sha256, spans.

    Null text counts as empty.  Offsets are code points, ends are exclusive.  Spans of
    one kind never overlap; base spans of different kinds may.  Repeated rows are
    searched each; an empty table gives no rows; other columns are ignored.
    """
    text = F.col("_text")
    rows = docs.select("doc_id", text_or_empty().alias("_text"))
    rows = rows.withColumns({f"_{kind}": spans for kind, spans in _base(text).items()})
    rows = rows.withColumn("_candidates", _candidates(text, [F.col(f"_{k}") for k in BASE]))
    light = [F.transform(f"_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in BASE]
    voted = F.transform("_candidates", _votes).alias("candidates")
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", *light, voted)
    found = materialize(rows, "spans")

    candidates = found.select("_row", F.explode("candidates").alias("c")).select("_row", "c.*")
    extra = _accepted(candidates).groupBy("_row").agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("s", "e")))).alias(k)
            for k in ("id", "secret")
        ]
    )
    none = F.array().cast("array<struct<s:int,e:int>>")
    told = found.drop("candidates").join(extra, "_row", "left")
    kinds = {k: F.coalesce(F.col(k), none) for k in KINDS}
    return told.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined({k: kinds[k] for k in BASE}).cast("binary"), 256).alias("base_sha256"),
        _joined(kinds).alias("spans"),
    )


def mask(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) with every span of ``found`` replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, by the kind of the first, the longest if several start there.
    """
    spans = F.transform(
        F.filter(F.split("spans", ","), lambda x: x != ""),
        lambda x: F.struct(
            F.split(x, ":")[1].cast("int").alias("s"), (-F.split(x, ":")[2].cast("int")).alias("e"), F.split(x, ":")[0].alias("k")
        ),
    )
    text = F.coalesce(F.col("text"), F.lit(""))

    def merged(rows: Column) -> Column:
        """The first span of each group with the end of the group before it."""
        def heads(upto: Column) -> Column:
            last = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0))
            marked = F.transform(
                rows, lambda x, i: F.struct(last(i).alias("at"), x["s"].alias("s"), x["k"].alias("k"), (x["s"] >= last(i)).alias("head"))
            )
            # The text behind the last group ends the list.
            rest = F.struct(F.array_max(upto).alias("at"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("string").alias("k"), F.lit(True).alias("head"))
            return F.concat(F.filter(marked, lambda x: x["head"]), F.array(rest))

        return _running(F.transform(rows, lambda x: -x["e"]), F.greatest, heads)

    def rebuilt(chars: Column) -> Column:
        part = lambda x: F.array_join(
            F.slice(chars, x["at"] + 1, F.coalesce(x["s"], F.size(chars)) - x["at"]), ""
        )
        mark = lambda x: F.when(x["k"].isNull(), "").otherwise(F.concat(F.lit("<"), x["k"], F.lit(">")))
        return F.array_join(F.transform(F.col("_heads"), lambda x: F.concat(part(x), mark(x))), "")

    joined = docs.select("doc_id", "text").join(found.select("doc_id", "spans"), "doc_id", "left")
    joined = joined.withColumn("_heads", F.when(F.col("spans") != "", _with(F.sort_array(spans), merged)))
    whole = _with(F.split(text, ""), rebuilt)
    return joined.select("doc_id", F.when(F.col("_heads").isNull(), F.col("text")).otherwise(whole).alias("text"))
