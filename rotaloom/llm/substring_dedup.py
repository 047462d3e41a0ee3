"""Substring dedup: words inside a window that also starts elsewhere are removed.

1.  Every window of WINDOW words names an anchor, the one of its ANCHOR-word grams with
    the smallest hash (the leftmost of equals).  Equal windows have equal anchors, and
    consecutive windows with one anchor place form a stretch.  Anchors that only one
    stretch has cannot belong to a repeated window; the rest are candidates.
2.  Stretches with candidate anchors are dealt out to shards by anchor, equal stretches
    being combined and counted on the way.  Stretches of a very frequent anchor are cut
    into their windows, which are dealt out by their own content, so that no anchor
    fills a shard.  Windows that are equal always meet in one shard.
3.  Each shard is a compressed FM-index over its distinct stretches.  Those that occur
    more than once are repeated as a whole; all others are streamed against the index,
    and backward search gives for each word how many words up to it occur twice.  Where
    that reaches WINDOW, the window is reported.
4.  Reported windows go back to the documents, which drop the words they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.llm.common import (
    chunks,
    distinct_words,
    gram_hashes,
    map_arrow,
    materialize,
    slices,
    text_or_empty,
    word_hashes,
    word_spans,
)
from rotaloom.llm.fm_index import FMIndex

WINDOW, ANCHOR = 35, 12
FREQUENT_ANCHOR = 2000
SHARD_WORDS = 250_000
SLICE_BYTES = 1 << 20
SALTS = 8
KEY = ["doc_id", "text_hash"]


# -- anchors -----------------------------------------------------------------
def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def stretches(words: np.ndarray, reach: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """Stretches of texts given as word hashes: text number, anchor, first word in its text, number of windows."""
    none = np.empty(0, np.int64)
    if len(words) < window:
        return none, none.astype(np.uint64), none, none
    grams = gram_hashes(words, anchor)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    place = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(((grams >> bits) << bits) | place, window - anchor + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(reach) - 1), np.diff(reach))
    starts = np.arange(len(at))
    inside = text[starts] == text[starts + window - 1]
    starts, at = starts[inside], at[inside]
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[starts[1:]] != text[starts[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    return text[begin], grams[at[first]], begin - reach[text[begin]], count


def _anchored(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, n_words, sha256 of its words, and its stretches."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, data, offsets in chunks(batch.column(2)):
                n = len(offsets) - 1
                starts, ends, reach = word_spans(data, offsets)
                text, anchors, begin, count = stretches(word_hashes(data, starts, ends), reach)
                raw = data.tobytes()
                digests = [
                    hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])
                ]
                bounds = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(bounds, pa.array(v))
                    for v in (anchors.view(np.int64), begin.astype(np.int32), count.astype(np.int32))
                ]
                yield pa.record_batch(
                    [batch.column(0).slice(low, n), batch.column(1).slice(low, n), pa.array(np.diff(reach)),
                     pa.array(digests, pa.string()), *lists],
                    names=["doc_id", "text_hash", "n_words", "sha256", "anchors", "begins", "counts"],
                )

    return map_arrow(
        docs, described,
        "doc_id long, text_hash long, n_words long, sha256 string, anchors array<bigint>, begins array<int>, counts array<int>",
    )


# -- pieces of the candidate stretches ---------------------------------------
def _cut(batches: Iterator[pa.RecordBatch], with_content: bool) -> Iterator[pa.RecordBatch]:
    """The candidate stretches of documents (doc_id, text_hash, text, hits); windows one by one for frequent anchors."""
    for whole in batches:
        for low, high in slices(whole.column(2), SLICE_BYTES):
            batch = whole.slice(low, high - low)
            rows = []
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text_hash, text, hits in zip(ids, hashes, batch.column(2), batch.column(3).to_pylist()):
                words = text.as_buffer().to_pybytes().split()
                for hit in hits:
                    begin, count, anchor, n = hit["begin"], hit["count"], hit["anchor"], hit["n"]
                    often = n > FREQUENT_ANCHOR
                    for first, k in [(begin + i, 1) for i in range(count)] if often else [(begin, count)]:
                        content = b" ".join(words[first : first + k + WINDOW - 1])
                        digest = hashlib.blake2b(content, digest_size=16).digest()
                        if with_content:
                            spread = int.from_bytes(digest[:4], "little") % (n // FREQUENT_ANCHOR + 1) if often else 0
                            rows.append((anchor, spread, digest, content, k))
                        else:
                            rows.append((doc_id, text_hash, digest, first))
            columns = list(zip(*rows)) or [()] * (5 if with_content else 4)
            if with_content:
                types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
                names = ["anchor", "spread", "digest", "content", "windows"]
            else:
                types = [pa.int64(), pa.int64(), pa.binary(), pa.int32()]
                names = ["doc_id", "text_hash", "digest", "first"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _cut(batches, True)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _cut(batches, False)


# -- shards ------------------------------------------------------------------
def repeated_windows(contents: list[bytes], counts: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each distinct content (words joined by a space) the first words of its repeated windows."""
    lengths = np.array([c.count(b" ") + 1 for c in contents], np.int64)
    ends = np.cumsum(lengths)
    out = [np.arange(max(n - window + 1, 0)) if c > 1 else np.empty(0, np.int64) for n, c in zip(lengths, counts)]
    if not (counts == 1).any():
        return out
    data = np.frombuffer(b"\n".join(contents), np.uint8)
    starts, stops, _ = word_spans(data, np.array([0, len(data)]))
    codes, first = distinct_words(data, starts, stops)
    # Symbol 0 closes each content, so no match reaches across.
    text = np.insert(codes.astype(np.int64) + 1, ends, 0)
    index = FMIndex(text, len(first) + 1, window)
    begins = ends - lengths + np.arange(len(contents))
    asked = np.flatnonzero((counts == 1) & (lengths >= window))
    places = np.concatenate([begins[i] + np.arange(window - 1, lengths[i]) for i in asked]) if len(asked) else ends[:0]
    owner = np.repeat(asked, lengths[asked] - window + 1)
    reached = index.repeated_lengths(text, places, np.full(len(places), window)) >= window
    places, owner = places[reached], owner[reached]
    for i in np.unique(owner).tolist():
        out[i] = places[owner == i] - begins[i] - window + 1
    return out


def _ranges(windows: np.ndarray) -> list[dict]:
    """Runs of consecutive windows as (from, to), to exclusive."""
    if not len(windows):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(windows) != 1]))
    lows, highs = windows[new], windows[np.append(new[1:], len(windows)) - 1]
    return [{"from": int(a), "to": int(b) + 1} for a, b in zip(lows, highs)]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, digest, content, n) sorted by shard: the repeated windows of each content."""
    number, held = None, []

    def done() -> pa.RecordBatch:
        found = repeated_windows([h[1] for h in held], np.array([h[2] for h in held]))
        good = [(h[0], _ranges(w)) for h, w in zip(held, found) if len(w)]
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        return pa.record_batch(
            [pa.array([g[0] for g in good], pa.binary()), pa.array([g[1] for g in good], kind)], names=["digest", "ranges"]
        )

    for batch in batches:
        for shard, digest, content, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if shard != number and held:
                yield done()
                held = []
            number = shard
            held.append((digest, content, n))
    if held:
        yield done()


# -- documents ---------------------------------------------------------------
def _removed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_removed, digests, texts = [], [], []
        for text, ranges in zip(batch.column(2), batch.column(3).to_pylist()):
            words = text.as_buffer().to_pybytes().split()
            edge = np.zeros(len(words) + 1, np.int64)
            for r in ranges:
                edge[r["from"]] += 1
                edge[r["to"] + WINDOW - 1] -= 1
            covered = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, c in zip(words, covered.tolist()) if not c])
            n_removed.append(int(covered.sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8", "replace") if with_text else None)
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()),
             pa.array(texts, pa.string())],
            names=["doc_id", "text_hash", "n_removed", "kept_sha256", "kept"],
        )


def _removed_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _removed(batches, False)


def _removed_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _removed(batches, True)


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, text_hash); null ids are equal.  The key of ``right`` is dropped."""
    other = right.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), *[c for c in right.columns if c not in KEY])
    return left.join(other, left["doc_id"].eqNullSafe(F.col("_d")) & (left["text_hash"] == F.col("_t")), how).drop("_d", "_t")


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept.

    ``kept`` is the kept words joined by one space where words were removed, else null.
    Null text has no words.  Repeated rows repeat each other's windows, so all of their
    windows go.  Texts shorter than a window keep all words.  An empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text")
    )
    described = materialize(_anchored(rows), "stretches")
    zipped = F.explode(F.arrays_zip("anchors", "begins", "counts")).alias("x")
    placed = described.select(*KEY, zipped).select(
        *KEY, F.col("x.anchors").alias("anchor"), F.col("x.begins").alias("begin"), F.col("x.counts").alias("count")
    )
    # As a table of its own, so that both sides of the join are dealt out and a hot anchor can be split.
    repeated = materialize(placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchors")
    hits = placed.join(repeated, "anchor").groupBy(*KEY).agg(
        F.collect_set(F.struct("begin", "count", "anchor", "n")).alias("hits")
    )
    hits = materialize(hits, "hits")
    found = materialize(_same(rows, hits, "inner").select(*KEY, F.encode("text", "utf-8").alias("text"), "hits"), "texts")

    contents = map_arrow(found, _contents, "anchor long, spread int, digest binary, content binary, windows int")
    distinct = contents.groupBy("anchor", "spread", "digest", "content").agg(
        F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows")
    )
    distinct = materialize(distinct, "contents")
    n_words = distinct.agg(F.sum(F.col("windows") + WINDOW)).first()[0] or 0
    n_shards = max(1, -(-int(n_words) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("anchor", "spread"), F.lit(n_shards)).alias("shard")
    dealt = distinct.select(shard, "digest", "content", "n").repartition("shard").sortWithinPartitions("shard", "digest")
    marks = materialize(map_arrow(dealt, _searched, "digest binary, ranges array<struct<from:int,to:int>>"), "marks")

    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int").alias("_salt")
    spread = marks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = map_arrow(found.select(*KEY, "text", "hits"), _places, "doc_id long, text_hash long, digest binary, first int")
    back = places.select("*", salt(*KEY, "first")).join(spread, ["digest", "_salt"]).select(*KEY, "first", F.explode("ranges").alias("r"))
    ranges = back.groupBy(*KEY).agg(
        F.collect_set(
            F.struct((F.col("first") + F.col("r.from")).alias("from"), (F.col("first") + F.col("r.to")).alias("to"))
        ).alias("ranges")
    )
    cut = _same(found.select(*KEY, "text").dropDuplicates(KEY), materialize(ranges, "ranges"), "inner")
    cut = map_arrow(
        cut.select(*KEY, "text", "ranges"), _removed_text if with_text else _removed_digest,
        "doc_id long, text_hash long, n_removed long, kept_sha256 string, kept string",
    )
    told = _same(described.select(*KEY, "n_words", "sha256"), cut, "left")
    return told.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), *(["kept"] if with_text else []),
    )
