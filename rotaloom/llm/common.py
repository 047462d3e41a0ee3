"""Shared pieces of the text operators: tables, staging, word spans and hashes.

Words are runs of bytes other than the six ASCII white-space bytes, which is the
pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8.  All hashes depend on content alone,
so results do not depend on partitions, batches or retries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaloom.plans.scratch import materialize
from rotaloom.plans.workers import ship

WHITE = " \t\n\x0b\f\r"
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
READER_SETTING = "spark.sql.parquet.columnarReaderBatchSize"
CHUNK_BYTES = 1 << 20
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_SECOND_BASE = 0xD6E8FEB86659FD93 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1

__all__ = ["WHITE", "documents", "materialize", "map_arrow", "ship", "text_or_empty", "pack", "chunks", "slices", "word_spans", "span_hashes", "word_hashes", "gram_hashes", "distinct_words"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int, read: int | None = None) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is written inside; the session's settings are put back.

    With ``read`` Parquet is also decoded at most that many rows at a time, for tables whose rows are large.
    """
    wanted = {BATCH_SETTING: rows} | ({READER_SETTING: read} if read else {})
    before = {setting: spark.conf.get(setting) for setting in wanted}
    for setting, most in wanted.items():
        own = int(before[setting])
        spark.conf.set(setting, str(most if own <= 0 else min(own, most)))
    try:
        yield
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_TABLES: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """Kept for one chunk; longer tables are made for the one long text that needs them."""
    root = pow(base, -1, 1 << 64) if inverse else base
    if n > CHUNK_BYTES + 1:
        return _powers(root, n)
    key = (base, inverse)
    if key not in _TABLES:
        _TABLES[key] = _powers(root, CHUNK_BYTES + 1)
    return _TABLES[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(docs: DataFrame, needed: list[str]) -> tuple[DataFrame, list[Column]]:
    """The needed columns beside one struct of all others, and the columns that restore ``docs``.

    So an operator's helper columns cannot clash with columns that it passes through.
    """
    others = [c for c in docs.columns if c not in needed]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    packed = docs.select(*[F.col(f"`{c}`") for c in needed], rest.alias("_rest"))
    place = {c: F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(others)}
    return packed, [place.get(c, F.col(f"`{c}`")) for c in docs.columns]


_BYTE_VALUES = mix((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts, about ``most`` bytes at a time: first index, bytes, text offsets.  Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def slices(array: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        base = ends[first] - sizes[first]
        last = max(int(np.searchsorted(ends, base + most, side="right")), first + 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the range of words of each text."""
    solid = (data > 32) | (data < 9) | ((data > 13) & (data < 32))
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = solid
    before[offsets[:-1]] = False
    after = np.empty(len(data) + 1, bool)
    after[-1] = False
    after[:-1] = solid
    after[offsets[1:]] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of the items of each span, given a random value for every item."""
    out = np.empty(len(starts), np.uint64)
    # Stretches of whole spans, so that the tables of powers stay small.
    first = 0
    while first < len(starts):
        origin = int(starts[first])
        last = max(int(np.searchsorted(ends, origin + CHUNK_BYTES, side="right")), first + 1)
        piece = values[origin : int(ends[last - 1])]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * powers(base, len(piece)), out=total[1:])
        low, high = starts[first:last] - origin, ends[first:last] - origin
        shifted = (total[high] - total[low]) * powers(base, len(piece) + 1, inverse=True)[low]
        out[first:last] = mix(shifted ^ ((high - low).astype(np.uint64) << np.uint64(48)))
        first = last
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BYTE_BASE) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    return span_hashes(_BYTE_VALUES[data], starts, ends, base)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each word, equal for equal words, and for each code the index of a word that has it.

    Words are told apart by two independent 64-bit hashes.
    """
    import pandas as pd

    hashes = word_hashes(data, starts, ends)
    codes, values = pd.factorize(hashes)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    second = word_hashes(data, starts, ends, _SECOND_BASE)
    if len(codes) and (second != second[first[codes]]).any():
        pairs = pd.MultiIndex.from_arrays([hashes, second])
        codes, values = pd.factorize(pairs)
        first = np.empty(len(values), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive word hashes; shorter than ``words`` by n - 1."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_WORD_BASE, len(words)), out=total[1:])
    shifted = (total[n:] - total[:-n]) * powers(_WORD_BASE, len(words) + 1, inverse=True)[: len(words) - n + 1]
    return mix(shifted + np.uint64(n))
