"""Subword encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is a merge-type (BPE) piece model with byte fallback.  A text is a
space mark, then its characters with spaces turned into space marks.  The agenda of a
stretch of text holds every adjacent pair whose concatenation is a piece; the best
scored pair, the leftmost of equals, is merged until none is left.  With dropout, a
candidate merge is skipped for good when a keyed hash of its place (seed, document
and copy, number of the stretch in the document, span) falls below the rate, so one
seed always gives the same segmentation and another seed another one, and every
occurrence of a stretch draws for itself.  With rate 0 the ids are those of the library.

Stretches are cut where no piece can reach across: at space marks after other
characters and around characters that no merge contains.  All distinct stretches of
a batch are merged in step by array operations; very long ones use a heap.  Occurrences
that skip none of the candidates met there have that segmentation; all others are merged
one by one, in step as well.

Characters outside the vocabulary become bytes, and so does the mark character itself
when a text contains it, so decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.llm.common import map_arrow, mix, pack, slices, span_hashes

MARK = "▁"
RATE, SEED = 0.1, 2024
LONG = 96
CHUNK_CHARS, SLICE_BYTES = 1 << 18, 1 << 18
_MASK = (1 << 64) - 1
_PLACE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
_NEVER = np.int64(1 << 40)
_SECOND = 0xD6E8FEB86659FD93 | 1
_FIRST = 0x9E3779B97F4A7C15 | 1


def _mix_int(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


class Pieces:
    """Vocabulary tables.  Symbols below ``size`` are pieces, ``size + c`` is character c outside the vocabulary."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = library.get_piece_size()
        ids = range(self.size)
        names = [library.id_to_piece(i) for i in ids]
        normal = {
            n: i for i, n in enumerate(names)
            if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))
        }
        self.bytes = np.full(256, -1, np.int64)
        for i in ids:
            if library.is_byte(i):
                self.bytes[int(names[i][3:5], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for name, i in normal.items():
            if len(name) == 1 and name != MARK:
                self.symbol[ord(name)] = i
        self.symbol[ord(" ")] = normal.get(MARK, self.size + ord(MARK))
        self.mark = int(self.symbol[ord(" ")])

        def of(part: str) -> int | None:
            found = normal.get(part)
            return int(self.symbol[ord(part)]) if found is None and len(part) == 1 else found

        order = {s: r for r, s in enumerate(sorted({-library.get_score(i) for i in normal.values()}))}
        self.rank = np.zeros(self.size, np.int64)
        pairs = {}
        for name, i in normal.items():
            self.rank[i] = order[-library.get_score(i)]
            for cut in range(1, len(name)):
                left, right = of(name[:cut]), of(name[cut:])
                if left is not None and right is not None:
                    pairs[left * (1 << 22) + right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs
        self._hash_table()
        # Characters that some merge contains, and whether marks stand only at the start of pieces.
        self.merges = np.zeros(0x110000, bool)
        self.merges[sorted({ord(c) for n in normal if len(n) > 1 for c in n if c != MARK})] = True
        self.merges[ord(" ")] = True
        self.cut_at_marks = not any(MARK in n.lstrip(MARK) for n in normal)
        surface = [n.replace(MARK, " ").encode() for n in names]
        for b, i in enumerate(self.bytes.tolist()):
            surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_length = np.array([len(s) for s in surface], np.int64)
        self.surface_begin = np.cumsum(self.surface_length) - self.surface_length

    def _hash_table(self) -> None:
        self.bits = max(4, int(len(self.keys) * 4).bit_length())
        self.slots = np.full((1 << self.bits) + 1, -1, np.int64)
        left = np.arange(len(self.keys))
        place = self._slot(self.keys)
        while len(left):  # linear probing: the first claimant of a free slot gets it
            free = self.slots[place] < 0
            claim, first = np.unique(place[free], return_index=True)
            self.slots[claim] = left[free][first]
            lost = self.slots[place] != left
            left, place = left[lost], (place[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_FIRST)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        keys = left * (1 << 22) + right
        out = np.full(len(keys), -1, np.int64)
        open_, place = np.arange(len(keys)), self._slot(keys)
        while len(open_):
            at = self.slots[place]
            hit = (at >= 0) & (self.keys[at] == keys[open_])
            out[open_[hit]] = self.values[at[hit]]
            more = (at >= 0) & ~hit
            open_, place = open_[more], (place[more] + 1) & ((1 << self.bits) - 1)
        return out

    # -- merging -------------------------------------------------------------
    def merge_heap(self, symbols: list[int], key: int, limit: int) -> list[int]:
        """The agenda of one stretch as a heap; candidates whose keyed hash is below ``limit`` are skipped."""
        n = len(symbols)
        symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= n:
                return
            piece = self.pairs.get(symbols[i] * (1 << 22) + symbols[j])
            if piece is None:
                return
            if limit and _mix_int((key + i * _PLACE[0] + j * _PLACE[1] + end[j] * _PLACE[2]) & _MASK) < limit:
                return
            heapq.heappush(agenda, (int(self.rank[piece]), i, end[j], piece))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while agenda:
            _, i, upto, piece = heapq.heappop(agenda)
            j = after[i] if not gone[i] else n
            if j >= n or end[j] != upto or self.pairs.get(symbols[i] * (1 << 22) + symbols[j]) != piece:
                continue
            symbols[i], end[i], after[i], gone[j] = piece, end[j], after[j], True
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s, g in zip(symbols, gone) if not g]

    def merge_all(
        self, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, limit: int, seen: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Merge many stretches in step: their symbols one after the other, and how many each keeps.

        ``seen`` takes up the stretch and the hashed span of every candidate that is met, but for very long stretches.
        """
        numbers = np.arange(len(lengths))
        done_numbers: list[np.ndarray] = []
        done_symbols: list[np.ndarray] = []
        bounds = np.cumsum(lengths) - lengths
        long = lengths > LONG
        for i in np.flatnonzero(long).tolist():
            kept = self.merge_heap(symbols[bounds[i] : bounds[i] + lengths[i]].tolist(), int(keys[i]), limit)
            done_symbols.append(np.array(kept, np.int64))
            done_numbers.append(np.full(len(kept), i))
        seg = np.repeat(numbers, lengths)
        start = np.arange(len(symbols)) - np.repeat(bounds, lengths)
        if long.any():
            short = ~long[seg]
            seg, start, symbols = seg[short], start[short], symbols[short]
        sym, end = symbols.astype(np.int64), start + 1

        def score(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and piece of the pairs (at, at + 1) that lie in one stretch."""
            piece = self.merged(sym[at], sym[at + 1])
            if limit or seen is not None:
                met = np.flatnonzero(piece >= 0)
                pair = at[met]
                span = np.zeros(len(met), np.uint64)
                for offset, factor in zip((start[pair], start[pair + 1], end[pair + 1]), _PLACE):
                    span += offset.astype(np.uint64) * np.uint64(factor)
                if seen is not None:
                    seen.append((seg[pair], span))
                if limit:
                    piece[met[mix(keys[seg[pair]] + span) < np.uint64(limit)]] = -1
            return np.where(piece < 0, _NEVER, self.rank[piece]), piece

        rank, piece = np.full(len(sym), _NEVER), np.full(len(sym), -1, np.int64)
        inside = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inside], piece[inside] = score(inside)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            wide = np.repeat(best, sizes)
            over = wide == _NEVER
            if over.any():
                done_numbers.append(seg[over])
                done_symbols.append(sym[over])
                open_ = ~over
                sym, seg, start, end, rank, piece, wide = (x[open_] for x in (sym, seg, start, end, rank, piece, wide))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == wide)
            at = at[np.concatenate([[True], seg[at[1:]] != seg[at[:-1]]])]  # the leftmost of each stretch
            sym[at], end[at] = piece[at], end[at + 1]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, seg, start, end, rank, piece = (x[stay] for x in (sym, seg, start, end, rank, piece))
            at = at - np.arange(len(at))
            for place in (at, at[at > 0] - 1):
                pair = (place + 1 < len(sym)) & (seg[np.minimum(place + 1, len(sym) - 1)] == seg[place])
                rank[place[~pair & (place + 1 >= len(sym))]] = _NEVER
                rank[place[~pair]] = _NEVER
                rank[place[pair]], piece[place[pair]] = score(place[pair])
        if not done_symbols:
            return np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
        where, what = np.concatenate(done_numbers), np.concatenate(done_symbols)
        return what[np.argsort(where, kind="stable")], np.bincount(where, minlength=len(lengths))

    # -- texts ---------------------------------------------------------------
    def encode(self, texts: list[str], keys: np.ndarray, rate: float = 0.0, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after the other, and the number of ids of each; ``keys`` are the documents' hashes."""
        ids, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK_CHARS):
                size += len(texts[last]) + 1
                last += 1
            part = self._encode_chunk(texts[first:last], keys[first:last], rate, seed)
            ids.append(part[0])
            counts.append(part[1])
            first = last
        return np.concatenate(ids), np.concatenate(counts)

    def _encode_chunk(self, texts: list[str], keys: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        marked = ["" if not t else " " + t for t in texts]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) for t in marked], np.int64)
        if not len(codes):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        space, free = codes == 32, ~self.merges[codes]
        cut = np.zeros(len(codes), bool)
        cut[offsets[:-1][sizes > 0]] = True
        cut[1:] |= free[1:] | free[:-1]
        if self.cut_at_marks:
            cut[1:] |= space[1:] & ~space[:-1]
        begins = np.flatnonzero(cut)
        ends = np.append(begins[1:], len(codes))
        reach = np.searchsorted(begins, offsets)

        values = mix((codes + 1).astype(np.uint64) * np.uint64(_FIRST))
        hashes = span_hashes(values, begins, ends, _FIRST)
        second = span_hashes(values, begins, ends, _SECOND)
        limit = min(int(rate * 2**64), _MASK)
        codes_of, firsts = pd.factorize(hashes)
        rep = np.empty(len(firsts), np.int64)
        rep[codes_of[::-1]] = np.arange(len(codes_of) - 1, -1, -1)
        if (second != second[rep[codes_of]]).any():
            codes_of, firsts = pd.factorize(pd.MultiIndex.from_arrays([hashes, second]))
            rep = np.empty(len(firsts), np.int64)
            rep[codes_of[::-1]] = np.arange(len(codes_of) - 1, -1, -1)

        seen: list[tuple[np.ndarray, np.ndarray]] | None = [] if limit else None
        kept, counts = self._merge_spans(codes, begins[rep], ends[rep], hashes[rep], 0, seen)
        if limit:
            ordinal = np.arange(len(begins)) - np.repeat(reach[:-1], np.diff(reach))
            of_seed = np.uint64(_mix_int((seed * _SECOND + 1) & _MASK))
            drawn = mix(np.repeat(mix(keys ^ of_seed), np.diff(reach)) + ordinal.astype(np.uint64) * np.uint64(_FIRST))
            own = np.flatnonzero(self._skips(codes_of, drawn, seen, limit, len(rep)) | (ends - begins > LONG))
            more, more_counts = self._merge_spans(codes, begins[own], ends[own], drawn[own], limit)
            codes_of = codes_of.copy()
            codes_of[own] = len(rep) + np.arange(len(own))
            kept, counts = np.concatenate([kept, more]), np.concatenate([counts, more_counts])
        kept, counts = self._with_bytes(kept, counts)
        begin = np.cumsum(counts) - counts
        of = counts[codes_of]
        upto = np.cumsum(of)
        source = np.repeat(begin[codes_of] - (upto - of), of) + np.arange(int(of.sum()))
        return kept[source], np.diff(np.concatenate([[0], upto])[reach])

    def _merge_spans(
        self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, keys: np.ndarray, limit: int, seen: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """``merge_all`` of stretches of a text."""
        lengths = ends - begins
        upto = np.cumsum(lengths)
        source = np.repeat(begins - (upto - lengths), lengths) + np.arange(int(lengths.sum()))
        return self.merge_all(self.symbol[codes[source]], lengths, keys, limit, seen)

    def _skips(self, codes_of: np.ndarray, keys: np.ndarray, seen: list, limit: int, n: int) -> np.ndarray:
        """Whether an occurrence skips one of the ``seen`` candidates of its stretch, of which there are ``n``."""
        stretch = np.concatenate([np.empty(0, np.int64), *[s for s, _ in seen]])
        spans = np.concatenate([np.empty(0, np.uint64), *[p for _, p in seen]])
        spans = spans[np.argsort(stretch, kind="stable")]
        counts = np.bincount(stretch, minlength=n)
        of = counts[codes_of]
        upto = np.cumsum(of)
        source = np.repeat((np.cumsum(counts) - counts)[codes_of] - (upto - of), of) + np.arange(int(of.sum()))
        hit = mix(np.repeat(keys, of) + spans[source]) < np.uint64(limit)
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[upto] > total[upto - of]

    def _with_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as byte pieces."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, counts
        coded = [chr(c).encode("utf-8", "surrogatepass") for c in (symbols[odd] - self.size).tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(c) for c in coded]
        out = np.repeat(symbols, width)
        starts = np.cumsum(width) - width
        raw = np.frombuffer(b"".join(coded), np.uint8)
        inside = np.repeat(starts[odd], width[odd]) + np.arange(len(raw)) - np.repeat(np.cumsum(width[odd]) - width[odd], width[odd])
        out[inside] = self.bytes[raw]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of ids one after the other, ``counts`` for each text."""
        if not len(counts):
            return []
        width = self.surface_length[ids]
        upto = np.cumsum(width)
        source = np.repeat(self.surface_begin[ids] - (upto - width), width) + np.arange(int(width.sum()))
        raw = self.surface[source].tobytes()
        ends = np.concatenate([[0], upto])[np.cumsum(counts)].tolist()
        return [raw[a:b][1:] for a, b in zip([0, *ends[:-1]], ends)]  # without the mark before the text


_LOADED: dict[str, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """One set of tables per worker process and model."""
    key = hashlib.sha1(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about SLICE_BYTES with their texts; never all texts of a batch as Python strings."""
    for low, high in slices(batch.column(column), SLICE_BYTES):
        yield low, high, [t or "" for t in batch.column(column).slice(low, high - low).to_pylist()]


def encode(docs: DataFrame, model_file: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """``docs`` with piece_ids and n_pieces instead of text.

    Null and empty texts have no pieces.  Equal rows are numbered, and each of these
    copies draws its own dropout; rows without doc_id count as one document.  An empty
    table stays empty.  Columns of ``docs`` with one of the new names give way.
    """
    with open(model_file, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    packed, restored = pack(docs, ["doc_id", "text"])
    counted = packed.groupBy("doc_id", "text", "_rest").agg(F.count(F.lit(1)).alias("_copies"))
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    rows = copies.select("doc_id", "_rest", F.xxhash64("doc_id", "_copy").alias("_key"), "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(model.value)
        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for low, high, texts in _texts(batch, 3):
                ids, counts = tables.encode(texts, keys[low:high], rate, seed)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
                columns = [batch.column(i).slice(low, high - low) for i in range(2)]
                yield pa.record_batch([*columns, lists, pa.array(counts)], names=["doc_id", "_rest", "_ids", "_n"])

    schema = rows.select("doc_id", "_rest", F.array(F.lit(0)).alias("_ids"), F.lit(0).cast("long").alias("_n")).schema
    new = ("text", "piece_ids", "n_pieces")
    kept = [c for name, c in zip(docs.columns, restored) if name not in new]
    return map_arrow(rows, encoded, schema).select(*kept, F.col("_ids").alias("piece_ids"), F.col("_n").alias("n_pieces"))


def decode(rows: DataFrame, model_file: str) -> DataFrame:
    """``rows`` with text instead of piece_ids; null piece_ids give an empty text."""
    names = [c for c in rows.columns if c not in ("piece_ids", "text")]
    with open(model_file, "rb") as file:
        model = rows.sparkSession.sparkContext.broadcast(file.read())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(model.value)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(len(names)).to_pylist()]
            texts = tables.decode(np.concatenate([*lists, np.empty(0, np.int64)]), np.array([len(x) for x in lists], np.int64))
            columns = [batch.column(i) for i in range(len(names))]
            texts_out = pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())
            yield pa.record_batch([*columns, texts_out], names=[*names, "text"])

    chosen = rows.select(*[F.col(f"`{c}`") for c in names], "piece_ids")
    return map_arrow(chosen, decoded, chosen.drop("piece_ids").withColumn("text", F.lit("")).schema)


def round_trip(docs: DataFrame, model_file: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_pieces, ids_crc32, decoded_sha256, lossless.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit
    integers; ``lossless`` says whether decoding gave the text back (null: empty).
    Equal rows are one document here and get the same pieces.
    """
    with open(model_file, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(model.value)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for low, high, texts in _texts(batch, 2):
                ids, counts = tables.encode(texts, keys[low:high], rate, seed)
                back = tables.decode(ids, counts)
                ends = np.cumsum(counts).tolist()
                view = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1]], ends)]
                same = [b == t.encode("utf-8", "surrogatepass") for b, t in zip(back, texts)]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(counts),
                        pa.array(sums, pa.int64()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                        pa.array(same),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"],
                )

    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        rows, checked, f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    )
