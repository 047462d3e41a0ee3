"""Ranked lexical search with pair-bound MaxScore.

``build`` makes an index: every text goes to a shard of about SHARD_BYTES, and a shard is one row
with its terms in order, the postings (document, occurrences) of each term and the number of terms
of each document.  Nothing is shuffled; a shard is the block by which bounds are kept.

``search`` takes queries in blocks.  For a block

1.  the document counts of its terms are added up over the shards (only the terms and the
    bounds of their postings are read), which gives the weights;
2.  the shards are prepared: of the block's terms the postings with their impacts and the largest
    impact, and for pairs of neighbouring terms of a query, by weight, the intersection list with
    its largest joint impact.  A pair adds at most the largest of that joint impact and the two single ones, not
    the sum of the single ones, and it is that bound which enters step 3;
3.  every shard is searched by MaxScore: the terms with the least impacts, as many as together, pairs
    bounded jointly, cannot reach the score of the task's LIMIT-th document so far, open no document.
    Documents of the other terms' postings are scored, and are looked up in the remaining postings only as
    long as the remaining bound may still take them there;
4.  the tasks' best documents are ranked.

The impact of a term in a document is ``weight * ((10**9 * tf) div (1000 * tf + 12 * m))`` with
``m = 75 + (25 * n * N) div L``; scores are exact 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.llm.common import batches_of, chunks, distinct_words, map_arrow
from rotaloom.plans.scratch import Scratch

LIMIT = 20
SHARD_BYTES = 2 << 20
# Texts of one batch, and shards that are read and handed on together; a shard is a row of some megabytes.
TEXT_ROWS, SHARD_ROWS = 1000, 1
# Row groups of a few shards; else a writer first looks at its memory after a hundred rows.
FEW_SHARDS = {
    "parquet.block.size": str(16 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}
# Queries and characters of one block; its terms and weights are what is sent to the tasks.
QUERY_BLOCK, QUERY_CHARS = 4096, 16 << 20
LAST = (1 << 63) - 1

_TERM = np.zeros(256, bool)
_TERM[0x80:] = True
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _TERM[_low : _high + 1] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each term, and the range of terms of each text."""
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    solid = _TERM[data]
    before, after = np.empty(len(data) + 1, bool), np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, solid
    before[offsets[:-1]] = False
    after[-1], after[:-1] = False, solid
    after[offsets[1:]] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    return data, starts, np.flatnonzero(solid & ~after[1:]) + 1, np.searchsorted(starts, offsets)


def shard_row(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The index of some texts as one row."""
    data, starts, ends, reach = terms_of(data, offsets)
    codes, first = distinct_words(data, starts, ends)
    lengths = np.diff(reach)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    posts, tf = np.unique(rank[codes] * max(len(lengths), 1) + doc, return_counts=True)
    term, doc = np.divmod(posts, max(len(lengths), 1))
    row = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.record_batch(
        [row(ids), row(pa.array(lengths.astype(np.int64))), row(pa.array([words[i].decode() for i in order.tolist()], pa.string())),
         row(pa.array(np.searchsorted(term, np.arange(len(words) + 1)).astype(np.int32))),
         row(pa.array(doc.astype(np.int32))), row(pa.array(tf.astype(np.int32)))],
        names=["ids", "lengths", "terms", "bounds", "docs", "tfs"],
    )


SHARD = "ids array<bigint>, lengths array<bigint>, terms array<string>, bounds array<int>, docs array<int>, tfs array<int>"


def build(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """The index of all whole texts, a row for each shard, as a table in the shared folder.

    Null texts have no terms.  Rows with equal or null ids are documents of their own.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    with batches_of(docs.sparkSession, TEXT_ROWS):
        return (scratch or Scratch(docs.sparkSession)).keep(map_arrow(rows, shard_rows, SHARD), "shards", "shards", FEW_SHARDS)


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a task's texts; what does not fill one goes on with the next batch."""
    ids = texts = None
    for batch in batches:
        ids = batch.column(0) if ids is None else pa.concat_arrays([ids, batch.column(0)])
        texts = batch.column(1) if texts is None else pa.concat_arrays([texts, batch.column(1)])
        *full, last = chunks(texts, SHARD_BYTES) if len(texts) else [(0, None, None)]
        for first, data, offsets in full:
            yield shard_row(ids.slice(first, len(offsets) - 1), data, offsets)
        ids, texts = ids.slice(last[0]), texts.slice(last[0])
    for first, data, offsets in chunks(texts, SHARD_BYTES) if texts is not None else ():
        yield shard_row(ids.slice(first, len(offsets) - 1), data, offsets)


def query_terms(text: str | None) -> dict[str, int]:
    """The distinct terms of a query with their repeats."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    data, starts, ends, _ = terms_of(data, np.array([0, len(data)]))
    raw, out = data.tobytes(), {}
    for a, b in zip(starts.tolist(), ends.tolist()):
        term = raw[a:b].decode()
        out[term] = out.get(term, 0) + 1
    return out


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Plan:
    """A block of queries: its terms in order, their weights, each query's terms with repeats, and the pairs."""

    terms: pa.Array
    weights: np.ndarray
    n_docs: int
    n_terms: int
    queries: list[list[tuple[int, int]]]
    pairs: list[tuple[int, int]]
    matched: list[list[tuple[int, int, int]]]


def plan(queries: list[dict[str, int]], df: dict[str, int], n_docs: int, n_terms: int) -> Plan:
    """Terms that no document holds go; those of a query are paired off in the order of their weights."""
    terms = sorted({t for q in queries for t in q if df.get(t)})
    number = {t: i for i, t in enumerate(terms)}
    weights = [weight(df[t], n_docs) for t in terms]
    held = [sorted((number[t], k) for t, k in q.items() if t in number) for q in queries]
    pairs: dict[tuple[int, int], int] = {}
    matched = []
    for q in held:
        by_weight = sorted((t for t, _ in q), key=lambda t: (weights[t], t))
        both = [(min(a, b), max(a, b)) for a, b in zip(by_weight[::2], by_weight[1::2])]
        matched.append([(*p, pairs.setdefault(p, len(pairs))) for p in both])
    return Plan(pa.array(terms, pa.string()), np.array(weights, np.int64), n_docs, n_terms, held, list(pairs), matched)


def impacts(tf: np.ndarray, length: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    # (25 * n * N) div L in two parts, on Python integers where a product might leave 64 bits.
    per, rest = divmod(25 * n_docs, n_terms)
    wide = n_terms * int(length.max(initial=0)) > LAST
    part = (rest * length.astype(object)) // n_terms if wide else (rest * length) // n_terms
    m = 75 + per * length + part.astype(np.int64)
    return weights * ((1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m))


def joint(docs: list[np.ndarray], gains: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """The documents that hold both terms, and the largest sum of the two impacts, 0 without one."""
    both, a, b = np.intersect1d(*docs, assume_unique=True, return_indices=True)
    return both, int((gains[0][a] + gains[1][b]).max(initial=0))


def prepare(shard: dict, block: Plan) -> dict:
    """A shard's postings of the block's terms with impacts, and its pairs with their joint maxima."""
    lengths, bounds, docs, tfs = (np.asarray(shard[c].values) for c in ("lengths", "bounds", "docs", "tfs"))
    at = pc.index_in(block.terms, value_set=shard["terms"].values)
    number = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    at = at.drop_null().to_numpy()
    sizes = bounds[at + 1] - bounds[at]
    ends = np.cumsum([0, *sizes])
    taken = np.repeat(bounds[at] - ends[:-1], sizes) + np.arange(ends[-1])
    docs = docs[taken]
    gained = impacts(tfs[taken], lengths[docs], np.repeat(block.weights[number], sizes), block.n_docs, block.n_terms)
    own_docs, gains = ({t: x[i:j] for t, i, j in zip(number.tolist(), ends, ends[1:])} for x in (docs, gained))
    most, common = [], []
    for a, b in block.pairs:
        both, top = joint([own_docs[a], own_docs[b]], [gains[a], gains[b]]) if a in gains and b in gains else (docs[:0], 0)
        most.append(top)
        common.append(len(both))
    found = [p for p, n in enumerate(common) if n]
    return {
        "ids": shard["ids"].as_py(),
        "terms": number,
        "bounds": ends,
        "docs": docs,
        "gains": gained,
        "pairs": found,
        "n_both": [common[p] for p in found],
        "joint": [most[p] for p in found],
    }


READY = (
    "ids array<bigint>, terms array<bigint>, bounds array<bigint>, docs array<int>, gains array<bigint>, "
    "pairs array<bigint>, n_both array<bigint>, joint array<bigint>"
)


def partial_bounds(order: list[int], top: dict[int, int], matched: list[tuple[int, int, int]], joint_of: dict[int, int],
                   repeats: dict[int, int]) -> list[int]:
    """The most that the first 0, 1, 2 ... terms of ``order`` add to a score together."""
    partner = {}
    for a, b, p in matched:
        if a in top and b in top:
            both = max(repeats[a], repeats[b]) * joint_of.get(p, 0)
            most = min(top[a] + top[b], max(top[a], top[b], both))
            partner[a], partner[b] = (b, most), (a, most)
    out, seen = [0], set()
    for t in order:
        other, most = partner.get(t, (None, 0))
        out.append(out[-1] + (most - top[other] if other in seen else top[t]))
        seen.add(t)
    return out


class Best:
    """The LIMIT best documents of a query so far: scores descending, then ids ascending."""

    def __init__(self, limit: int):
        self.limit = limit
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """A lower score cannot come in any more."""
        return int(self.scores[-1]) if len(self.scores) == self.limit else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.limit]
        self.scores, self.ids = scores[order], ids[order]


def search_shard(ids: np.ndarray, docs: dict[int, np.ndarray], gains: dict[int, np.ndarray], top: dict[int, int],
                 query: list[tuple[int, int]], matched: list[tuple[int, int, int]], joint_of: dict[int, int],
                 best: Best) -> int:
    """Add a shard's documents to the best of a query; returns the number of documents that were opened."""
    repeats = {t: k for t, k in query if t in docs}
    most = {t: k * top[t] for t, k in repeats.items()}
    order = sorted(repeats, key=lambda t: (most[t], t))
    bound = partial_bounds(order, most, matched, joint_of, repeats)
    least = best.least()
    if bound[-1] < least:
        return 0
    # Each bound counts the terms before it, so it grows and can be searched.
    idle = int(np.searchsorted(np.array(bound), least, side="left")) - 1
    score = np.zeros(len(ids), np.int64)
    for t in order[idle:]:
        score[docs[t]] += gains[t] * repeats[t]  # a document occurs once in a list
    found = np.flatnonzero(score)
    total = score[found]
    opened = len(found)
    for k in range(idle, 0, -1):
        fits = total + bound[k] >= least
        found, total = found[fits], total[fits]
        if not len(found):
            return opened
        t = order[k - 1]
        at = np.minimum(np.searchsorted(docs[t], found), len(docs[t]) - 1)
        total += np.where(docs[t][at] == found, gains[t][at] * repeats[t], 0)
    fits = total >= least
    best.add(total[fits], ids[found[fits]])
    return opened


def _ready(batch: pa.RecordBatch, row: int) -> tuple:
    one = {c: np.asarray(batch.column(c)[row].values) for c in ("terms", "bounds", "docs", "gains", "pairs", "joint")}
    known = batch.column("ids")[row].values
    ids = np.asarray(known.fill_null(LAST))
    docs, gains, top = {}, {}, {}
    for i, t in enumerate(one["terms"].tolist()):
        part = slice(one["bounds"][i], one["bounds"][i + 1])
        docs[t], gains[t] = one["docs"][part], one["gains"][part]
        top[t] = int(gains[t].max())
    return ids, docs, gains, top, dict(zip(one["pairs"].tolist(), one["joint"].tolist()))


def _best_of(shards: DataFrame, block: Plan, limit: int, scratch: Scratch) -> DataFrame:
    """(query, doc_id, score): each task's best documents of each query."""
    shared = shards.sparkSession.sparkContext.broadcast(block)

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = prepare({c: batch.column(c)[row] for c in batch.schema.names}, shared.value)
                kinds = {"docs": pa.int32()}
                yield pa.record_batch(
                    [pa.array([one[c]], pa.list_(kinds.get(c, pa.int64()))) for c in one], names=list(one)
                )

    prepared = scratch.keep(map_arrow(shards, ready, READY), "impacts", "impacts", FEW_SHARDS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = [Best(limit) for _ in block.queries]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, docs, gains, top, joint_of = _ready(batch, row)
                for q, (query, matched) in enumerate(zip(block.queries, block.matched)):
                    search_shard(ids, docs, gains, top, query, matched, joint_of, best[q])
        for q, b in enumerate(best):
            if len(b.ids):
                yield pa.record_batch(
                    [pa.array(np.full(len(b.ids), q)), pa.array(b.ids, mask=b.ids == LAST), pa.array(b.scores)],
                    names=["query", "doc_id", "score"],
                )

    return map_arrow(prepared, search, "query long, doc_id long, score long")


def search(
    shards: DataFrame, queries: DataFrame, limit: int = LIMIT, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """The ``limit`` best documents of each query: item_id, rank, doc_id, score.

    Scores are above 0; equal ones go by ascending doc_id, null doc_ids last.  Queries without a term that
    a document holds give no rows, nor does an empty index.  Rows with equal id and text are one
    query; other rows with equal or null ids are ranked each by itself.  Other columns are ignored.
    The index may be deleted afterwards.
    """
    spark, scratch = shards.sparkSession, Scratch(shards.sparkSession)
    asked = queries.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).distinct()
    asked = scratch.keep(asked, "queries", "queries")
    told = shards.select(
        F.size(F.filter("lengths", lambda n: n > 0)).alias("n"),
        F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("l"),
    )
    n_docs, n_terms = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    count, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // QUERY_BLOCK), -(-size // QUERY_CHARS))
    in_block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    kind = asked.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    for block_nr in range(blocks if n_docs else 0):
        # A block of bounded size; the index is read once for each.
        some = asked.filter(in_block == block_nr).collect()
        held = [query_terms(r.text) for r in some]
        # Shards go one by one: those of a file together fill an executor.
        with batches_of(spark, SHARD_ROWS, SHARD_ROWS):
            block = plan(held, _document_counts(shards, {t for q in held for t in q}), n_docs, n_terms)
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(some)], f"query long, item_id {kind}")
            ranked = _best_of(shards, block, limit, scratch).withColumn("rank", F.row_number().over(order))
            ranked = ranked.filter(F.col("rank") <= limit).join(names, "query").select("item_id", "rank", "doc_id", "score")
            found = found.union(scratch.keep(ranked, "ranked"))
        scratch.remove("impacts")
    return found


def rank(docs: DataFrame, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``search`` in an index of ``docs`` (doc_id, text) that is deleted afterwards."""
    scratch = Scratch(docs.sparkSession)
    found = search(build(docs, scratch=scratch), queries, limit)
    scratch.remove("shards")
    return found


def _document_counts(shards: DataFrame, terms: set[str]) -> dict[str, int]:
    """For each of the given terms the number of documents that hold it."""
    shared = shards.sparkSession.sparkContext.broadcast(sorted(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at = pc.index_in(known, value_set=batch.column("terms")[row].values)
                bounds, place = np.asarray(batch.column("bounds")[row].values), at.drop_null().to_numpy()
                total[at.is_valid().to_numpy(zero_copy_only=False)] += bounds[place + 1] - bounds[place]
        held = total > 0
        yield pa.record_batch([known.filter(pa.array(held)), pa.array(total[held])], names=["term", "n"])

    told = map_arrow(shards.select("terms", "bounds"), count, "term string, n long")
    return {r.term: r.n for r in told.groupBy("term").agg(F.sum("n").alias("n")).collect()}
