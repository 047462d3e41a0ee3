"""Integer product codes of vectors by per-dimension value dictionaries.

Components become integers, floor(SCALE * x), and vectors are cut into PARTS stretches, each with
a codebook of ENTRIES integer entries.  Vectors are stored in blocks: a block holds, for each
dimension, the dictionary of the distinct integers that occur in it, and for each vector the
dictionary codes.  To compare a block with a codebook, the squared differences of every
dictionary value to that dimension of all entries are tabulated once; the distances of a
stretch are then gathers of table rows by code, added up over its dimensions.  A round reads the
blocks, assigns every stretch to the nearest entry (the lower index of equals) and adds up the
stretches of each entry in its tasks; Spark adds the tasks' sums, and the driver sees one row for
each entry and dimension.

All arithmetic is exact.  It is 64-bit while no sum of squares can leave 64 bits, and on Python
integers otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.llm.common import map_arrow
from rotaloom.llm.vector_join import matrix
from rotaloom.plans.scratch import Scratch

SCALE = 1024
PARTS, ENTRIES, TRAININGS = 4, 256, 4
BLOCK = 2048
LONG_MAX = (1 << 63) - 1
# ``large`` has the dictionaries of blocks with integers that a long cannot hold.
BLOCK_SCHEMA = (
    "vec_id array<bigint>, label array<{label}>, values array<bigint>, large array<string>, n_values array<int>, codes binary"
)


def sound(column: str):
    """Vectors that are not null and hold finite numbers only."""
    x = F.col(column)
    return F.coalesce(
        x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False)
    )


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: scaling by a power of two only moves the exponent."""
    floors = np.floor(x * SCALE)
    if np.abs(floors).max(initial=0.0) < 2.0**62:
        return floors.astype(np.int64)
    whole = [int(v) if np.isfinite(v) else int(raw) * SCALE for v, raw in zip(floors.ravel().tolist(), x.ravel().tolist())]
    return np.array(whole, object).reshape(x.shape)


def edges(dim: int) -> np.ndarray:
    """Bounds of the stretches: equal ones, the first ones longer by one if ``dim`` does not divide."""
    return np.cumsum([0, *(dim // PARTS + (p < dim % PARTS) for p in range(PARTS))])


def _calculable(values: np.ndarray, dim: int) -> np.ndarray:
    """64-bit integers if squared differences over ``dim`` dimensions fit them, else Python integers."""
    if not values.size:
        return values.astype(np.int64)
    most = max(abs(int(values.min())), abs(int(values.max())))
    return values.astype(np.int64 if dim * (2 * most) ** 2 <= LONG_MAX else object)


def encode(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    """One block: the dictionaries of all dimensions one after the other, and codes by dimension."""
    x = integers(matrix(batch.column("vector"), dim))
    values, sizes, codes = [], [], []
    for d in range(dim):
        distinct, code = np.unique(x[:, d], return_inverse=True)
        values.append(distinct)
        sizes.append(len(distinct))
        codes.append(code.astype("<u2"))
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    row = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    fits = flat.dtype != object
    small = row(pa.array(flat, pa.int64())) if fits else pa.nulls(1, pa.list_(pa.int64()))
    large = pa.nulls(1, pa.list_(pa.string())) if fits else row(pa.array([str(v) for v in flat], pa.string()))
    packed = np.concatenate(codes).tobytes() if codes else b""
    return pa.record_batch(
        [row(batch.column("vec_id")), row(batch.column("label")), small, large, row(pa.array(sizes, pa.int32())),
         pa.array([packed], pa.binary())],
        names=["vec_id", "label", "values", "large", "n_values", "codes"],
    )


class Block:
    """A stored block, ready to be compared with codebooks."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.vec_id, self.label = (batch.column(c)[row].values for c in ("vec_id", "label"))
        sizes = np.asarray(batch.column("n_values")[row].values)
        self.dim, self.bounds = len(sizes), np.cumsum([0, *sizes])
        small, large = batch.column("values")[row], batch.column("large")[row]
        self.values = np.asarray(small.values) if small.is_valid else np.array([int(v) for v in large.values.to_pylist()], object)
        packed = np.frombuffer(batch.column("codes")[row].as_py(), "<u2")
        self.codes = packed.reshape(self.dim, len(self.vec_id))

    def dictionary(self, d: int) -> np.ndarray:
        return self.values[self.bounds[d] : self.bounds[d + 1]]

    def assign(self, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every vector, by part."""
        ends = [v for x in (self.values, *books) if x.size for v in (x.min(), x.max())]
        kind, cut = _calculable(np.array(ends, object), self.dim).dtype, edges(self.dim)
        nearest = np.empty((PARTS, len(self.vec_id)), np.int64)
        least = np.empty((PARTS, len(self.vec_id)), kind)
        for p, book in enumerate(books):
            total = np.zeros((len(self.vec_id), len(book)), kind)
            for d in range(cut[p], cut[p + 1]):
                table = (self.dictionary(d).astype(kind)[:, None] - book[:, d - cut[p]].astype(kind)) ** 2
                total += table[self.codes[d]]
            nearest[p] = total.argmin(axis=1)
            least[p] = total[np.arange(len(total)), nearest[p]]
        return nearest, least


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in shared.value]
        total = [np.zeros(b.shape, object) for b in shared.value]
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                nearest, _ = block.assign(shared.value)
                cut = edges(block.dim)
                for p in range(PARTS):
                    count[p] += np.bincount(nearest[p], minlength=len(count[p]))
                    for d in range(cut[p], cut[p + 1]):
                        values = _calculable(block.dictionary(d), len(block.vec_id))[block.codes[d]]
                        part = np.zeros(len(count[p]), values.dtype)
                        np.add.at(part, nearest[p], values)
                        total[p][:, d - cut[p]] += part
        for p in range(PARTS):
            entry, place = np.nonzero(np.broadcast_to(count[p][:, None] > 0, total[p].shape))
            if len(entry):
                yield pa.record_batch(
                    [pa.array(np.full(len(entry), p)), pa.array(entry), pa.array(place), pa.array(count[p][entry]),
                     pa.array([str(t) for t in total[p][entry, place]], pa.string())],
                    names=["part", "entry", "place", "n", "total"],
                )

    told = map_arrow(blocks, add, "part long, entry long, place long, n long, total string")
    # One row for each of the bounded entries and dimensions.
    rows = told.groupBy("part", "entry", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")
    ).collect()
    out = [b.copy() for b in books]
    for r in rows:
        out[r.part][r.entry, r.place] = int(r.total) // r.n
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per vector that is kept: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are left out.  The first codebooks
    are the parts of the ENTRIES vectors with the smallest ids, fewer if there are fewer; of equal ids
    the smaller vector comes first, and null ids come last.  Repeated rows are encoded each by
    themselves.  Shorter vectors count as filled up with zeros; where four does not divide the
    length, the first parts are longer by one, and a vector without components has distance 0 from
    any entry.  Null labels form one label.  An empty table gives no rows; other columns are ignored.
    A sum that does not fit a long is given as the largest long.
    """
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    ).filter(sound("vector"))
    kind = rows.schema["label"].dataType.simpleString()
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow()
    dim = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    start = integers(matrix(first.column(0), dim)).astype(object) if len(first) else np.zeros((0, dim), object)
    cut = edges(dim)
    books = [start[:, cut[p] : cut[p + 1]] for p in range(PARTS)]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield encode(batch.slice(at, BLOCK), dim)

    scratch = Scratch(rows.sparkSession)
    blocks = scratch.keep(map_arrow(rows, encoded, BLOCK_SCHEMA.format(label=kind)), "blocks", "blocks")
    for _ in range(TRAININGS):
        books = _sums(blocks, books)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                nearest, least = block.assign(shared.value)
                code = [c.tobytes().hex() for c in nearest.T.astype(np.uint8)]
                error = np.minimum(least.sum(axis=0), LONG_MAX).astype(np.int64)
                yield pa.record_batch(
                    [block.vec_id, block.label, pa.array(code, pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    coded = scratch.keep(map_arrow(blocks, final, f"vec_id long, label {kind}, code string, error long"), "codes")
    scratch.remove("blocks")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    sums = scratch.keep(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "labels")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
