"""Token ids in a fixed-width bit-packed file format.

A token store is a Parquet folder whose rows are segments of whole documents in
ascending doc_id order: the document ids, their lengths, and one binary image.
The image holds the segment's ids in the fewest bits that the vocabulary needs:

    header   4s magic, u2 version, u2 bits, u4 ids per block, u8 ids, u4 blocks
    offsets  u8 for each block, from the start of the image
    blocks   ids one after the other, ``bits`` bits each, lowest bit first

Every block starts on a byte, so any range of ids is unpacked by a few numpy
operations on the blocks that it touches.  Spark's committer writes the folder,
so retried tasks leave no torn files, and a segment is bounded by SEGMENT_IDS ids
(one longer document makes one longer segment).
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaloom.llm.common import chunks, distinct_words, map_arrow, slices, word_spans

BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 20
SLICE_BYTES = 4 << 20
CACHED_WORDS = 700_000
MAGIC, VERSION = b"RLTB", 1
HEADER = struct.Struct("<4sHHIQI")
STORE = (
    "shard int, segment int, bits int, n_ids long, doc_ids array<bigint>, doc_lengths array<bigint>, image binary"
)
READ = "doc_id long, shard int, segment int, local_start long, n_tokens long, ids_crc32 long"


# -- bit packing -------------------------------------------------------------
def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` one after the other, ``bits`` bits each, lowest bit first."""
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, first: int, n: int, bits: int) -> np.ndarray:
    """``n`` ids from id ``first`` on of a packed block."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    at = np.arange(first, first + n, dtype=np.int64) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for i in range((bits + 7 + 7) // 8):
        word |= raw[byte + i].astype(np.uint64) << np.uint64(8 * i)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def build_image(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    start = HEADER.size + 8 * len(blocks)
    ends = np.cumsum([start, *map(len, blocks)], dtype=np.uint64)
    head = HEADER.pack(MAGIC, VERSION, bits, block_ids, len(ids), len(blocks))
    return b"".join([head, ends[:-1].astype("<u8").tobytes() if blocks else b"", *blocks])


class Image:
    """Random access to the ids of an image."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block_ids, self.n_ids, n_blocks = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token image")
        self.data = data
        offsets = np.frombuffer(data, "<u8", n_blocks, HEADER.size).astype(np.int64)
        self.offsets = np.append(offsets, len(data))

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        parts = []
        for block in range(start // self.block_ids, -(-stop // self.block_ids)):
            low = max(start - block * self.block_ids, 0)
            high = min(stop - block * self.block_ids, self.block_ids)
            parts.append(unpack(self.data[self.offsets[block] : self.offsets[block + 1]], low, high - low, self.bits))
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


# -- encoding ----------------------------------------------------------------
class WordEncoder:
    """Encodes whole texts through a bounded table of words already encoded.

    The vocabulary lower-cases and cuts at white space and between a letter and a
    mark.  So a text's ids are those of its words in order, A-Z may be lower-cased
    before (unless a special token could arise), and a full stop or comma after an
    ASCII letter at a word's end is a word of its own.  Every distinct word is encoded
    by the library.
    """

    def __init__(self, definition: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        plain = self.tokenizer.model
        out: list[bytes] = [b""] * len(words)
        others = []
        for i, word in enumerate(words):
            if word.isalpha() and word.islower():  # ASCII letters only: nothing to normalise or to cut
                out[i] = np.array([t.id for t in plain.tokenize(word.decode())], "<u4").tobytes()
            else:
                others.append(i)
        texts = [words[i].decode("utf-8", "replace") for i in others]
        for i, found in zip(others, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words; the tables keep those used last."""
        recent, older = self.recent, self.older
        found = [recent.get(w) for w in words]
        missing = [i for i, ids in enumerate(found) if ids is None]
        learn = []
        for i in missing:
            ids = older.get(words[i])
            if ids is None:
                learn.append(i)
            else:
                found[i] = recent[words[i]] = ids
        for i, ids in zip(learn, self._encode([words[i] for i in learn])):
            found[i] = recent[words[i]] = ids
        if len(recent) > CACHED_WORDS // 2:
            self.older, self.recent = recent, {}
        return found

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after the other, and the number of ids of each text."""
        parts = [self._encode_chunk(data, offsets, end_id) for _, data, offsets in chunks(texts, SLICE_BYTES)]
        if not parts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode_chunk(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None):
        raw = data.tobytes()
        if b"<|" not in raw:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
            raw = data.tobytes()
        starts, ends, reach = word_spans(data, offsets)
        # A full stop or comma after a letter becomes a word.
        long = ends - starts > 1
        last, previous = data[ends - 1], data[np.maximum(ends - 2, 0)] | 32
        cut = long & ((last == 44) | (last == 46)) & (previous >= 97) & (previous <= 122)
        place = np.arange(len(starts)) + np.cumsum(cut) - cut
        n_units = len(starts) + int(cut.sum())
        unit_start, unit_end = np.empty(n_units, np.int64), np.empty(n_units, np.int64)
        unit_start[place], unit_end[place] = starts, ends - cut
        unit_start[place[cut] + 1], unit_end[place[cut] + 1] = ends[cut] - 1, ends[cut]
        reach = reach + np.concatenate([[0], np.cumsum(cut)])[reach]

        codes, first = distinct_words(data, unit_start, unit_end)
        words = [raw[a:b] for a, b in zip(unit_start[first].tolist(), unit_end[first].tolist())]
        found = self._ids_of(words)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        pool = np.frombuffer(b"".join(found), "<u4")
        begins = np.cumsum(lengths) - lengths
        of_unit = lengths[codes]
        upto = np.cumsum(of_unit)
        source = np.repeat(begins[codes] - (upto - of_unit), of_unit) + np.arange(int(of_unit.sum()))
        reach = np.concatenate([[0], upto])[reach]
        ids, counts = pool[source], np.diff(reach)
        if end_id is None:
            return ids, counts
        return np.insert(ids, reach[1:], end_id), counts + 1


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(definition: bytes) -> WordEncoder:
    """One encoder per worker process and tokenizer."""
    key = hashlib.sha1(definition).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


# -- the store ---------------------------------------------------------------
def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write a token store at ``path``, in ascending doc_id order.

    Null text counts as empty and gives just the end id.  Null doc_ids come first;
    repeated rows are written as often as they occur, ordered by text.  An empty
    table gives a store without segments.  Other columns are ignored.
    """
    with open(tokenizer_file, "rb") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    from tokenizers import Tokenizer

    bits = bits_for(max(Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True), end_id + 1))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(definition.value)
        shard = TaskContext.get().partitionId()
        number, held = 0, 0
        keys: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            values = [shard, number, bits, len(flat), keys, np.concatenate(lengths).tolist(), build_image(flat, bits)]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "segment", "bits", "n_ids", "doc_ids", "doc_lengths", "image"]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES):
                part, counts = worker.encode(batch.column(1).slice(low, high - low), end_id)
                doc_ids = batch.column(0).slice(low, high - low).to_pylist()
                # Cut the slice wherever the open segment is full.
                ends = np.cumsum(counts)
                done = 0
                while done < len(counts):
                    used = ends[done - 1] if done else 0
                    upto = max(int(np.searchsorted(ends, used + segment_ids - held, side="right")), done)
                    if upto == done and not held:
                        upto = done + 1
                    if upto > done:
                        keys += doc_ids[done:upto]
                        lengths.append(counts[done:upto])
                        ids.append(part[used : ends[upto - 1]])
                        held += int(ends[upto - 1] - used)
                    if upto < len(counts):
                        yield row()
                        number, held, keys, lengths, ids = number + 1, 0, [], [], []
                    done = upto
        if keys:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(rows, segments, STORE).write.option("compression", "none").parquet(path)


def store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token store, from its images: doc_id, start, n_tokens, ids_crc32."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Image(row["image"]).ids().astype("<u4")
                lengths = np.asarray(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                n = len(lengths)
                yield pa.record_batch(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(np.full(n, row["shard"], np.int32)),
                        pa.array(np.full(n, row["segment"], np.int32)),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "shard", "segment", "local_start", "n_tokens", "ids_crc32"],
                )

    rows = store(spark, path)
    docs = map_arrow(rows.select("shard", "segment", "doc_ids", "doc_lengths", "image"), unpacked, READ)
    return docs.join(starts(rows), ["shard", "segment"]).select(
        "doc_id", (F.col("first_id") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def starts(rows: DataFrame) -> DataFrame:
    """The number of ids before each segment: running sums over shards and inside each shard."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select("shard", "segment", "n_ids")
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("shard").orderBy("segment"))), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    above = F.coalesce(F.sum("_n").over(before(Window.orderBy("shard"))), F.lit(0))
    shards = shards.select("shard", above.alias("_above"))
    return (
        sizes.withColumn("_inside", inside)
        .join(shards, "shard")
        .select("shard", "segment", (F.col("_above") + F.col("_inside")).alias("first_id"))
    )


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """The ids [start, stop) of a store, opening only the segments and blocks that hold them."""
    placed = starts(store(spark, path)).join(store(spark, path), ["shard", "segment"])
    hit = placed.filter((F.col("first_id") < stop) & (F.col("first_id") + F.col("n_ids") > start)).orderBy("first_id")
    parts = []
    for row in hit.select("first_id", "n_ids", "image").toLocalIterator():
        parts.append(Image(bytes(row.image)).ids(max(start - row.first_id, 0), stop - row.first_id))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)
