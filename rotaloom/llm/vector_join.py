"""Near-duplicate vectors through product quantisation.

1.  Equal vectors become one node that counts its rows, so copies cost nothing further.
2.  A bounded sample of nodes gives coarse centres and, from the residuals, one small
    codebook for each of PARTS subspaces.  Every node is then put on the inverted list of its
    nearest centre with its residual code and the length of what the code leaves out.
3.  Two linked unit vectors are at most ``reach = sqrt(2 - 2 * cosine)`` apart.  A query probes
    a list unless its distance to the plane between its own and the other centre exceeds a
    share of ``reach``: the partner lies beyond that plane, so the step between the two would
    have to point along the plane's normal by more than that share.  The share is SURE
    standard deviations of a random direction's coordinate (SURE / sqrt(dimension), at most 1,
    which makes the search exact), so the probes follow from the threshold and are not a cap.
4.  Lists and their queries meet in blocks of about BLOCK vectors.  A table lookup for
    each subspace gives the distance from a query to every coded vector; no pair is lost that
    the code's own error could explain.  The exact cosine of what remains decides.
5.  A block reports how many rows each node is linked with and a spanning forest of its
    links, never the pairs; components of the forests are components of all links.

Only SAMPLE vectors and the centres and codebooks made from them pass the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaloom.llm.common import map_arrow, ship
from rotaloom.llm.components import components
from rotaloom.plans.scratch import Scratch

COSINE = 0.95
SAMPLE = 16_384
PARTS, ENTRIES = 16, 256
BLOCK = 1024
ROUNDS = 10
SURE = 4.0
SALTS = 8
# Table sums are single precision; distances of unit vectors are off by far less than this.
ROUNDING = 1e-3


def usable(column: str) -> Column:
    """Vectors that are not null, empty or zero and hold finite numbers only."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows in double precision, shorter ones filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(np.asarray(vectors.offsets)[: len(vectors) + 1])
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first, so that no square overflows."""
    x = x / np.maximum(np.abs(x).max(axis=1, initial=0.0), np.finfo(float).tiny)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.maximum(out, 0, out=out)


def centres_of(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from ``k`` rows at even distances; centres without rows stay where they are."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(np.int64)].copy()
    for _ in range(rounds):
        own = squared(x, centres).argmin(axis=1)
        order = np.argsort(own, kind="stable")
        held, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centres[held] = sums / np.diff(np.append(first, len(x)))[:, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres, and a codebook of residuals for each stretch of dimensions."""

    centres: np.ndarray
    edges: np.ndarray
    books: list[np.ndarray]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, residual code and distance to what the code stands for, of each unit vector."""
        own = squared(x, self.centres).argmin(axis=1)
        rest = x - self.centres[own]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for p, book in enumerate(self.books):
            part = rest[:, self.edges[p] : self.edges[p + 1]]
            codes[:, p] = squared(part, book).argmin(axis=1)
            error += ((part - book[codes[:, p]]) ** 2).sum(axis=1)
        return own, codes, np.sqrt(error)

    def distances(self, x: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each query to each coded vector of a list, by lookups in one table a subspace."""
        rest = x - self.centres[place]
        total = np.zeros((len(x), len(codes)), np.float32)
        for p, book in enumerate(self.books):
            table = squared(rest[:, self.edges[p] : self.edges[p + 1]], book).astype(np.float32)
            total += np.take(table, codes[:, p], axis=1)
        return np.sqrt(total)

    def probes(self, x: np.ndarray, own: np.ndarray, far: float) -> np.ndarray:
        """Which lists each query probes: its own, and others whose dividing plane is within ``far``."""
        to = squared(x, self.centres)
        between = np.sqrt(squared(self.centres, self.centres))
        apart = to - to[np.arange(len(x)), own][:, None]
        near = apart <= 2 * far * between[own]
        near[np.arange(len(x)), own] = True
        return near


def fit(sample: np.ndarray, rows: int) -> Quantiser:
    """A quantiser from sampled unit vectors for an index of ``rows`` vectors.

    The lists grow with the root of the rows, up to one for 16 sampled vectors.
    """
    lists = max(1, min(math.isqrt(rows), len(sample) // 16))
    centres = centres_of(sample, lists)
    rest = sample - centres[squared(sample, centres).argmin(axis=1)]
    dim = sample.shape[1]
    edges = np.linspace(0, dim, min(PARTS, dim) + 1).astype(np.int64)
    books = [centres_of(np.ascontiguousarray(rest[:, a:b]), ENTRIES) for a, b in zip(edges[:-1], edges[1:])]
    return Quantiser(centres, edges, books)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` vertices the smallest vertex that it is connected with by the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        following = label.copy()
        np.minimum.at(following, a, low)
        np.minimum.at(following, b, low)
        following = following[following]
        if (following == label).all():
            return label
        label = following


def meet(model: Quantiser, place: int, queries: pa.Table, listed: pa.Table, dim: int, cosine: float) -> tuple:
    """Links of a block of queries and a block of one list: nodes with their links, and the forest's edges."""
    q_node, q_list, q_rows = (queries.column(c).to_numpy() for c in ("node", "own", "n_rows"))
    l_node, l_rows, error = (listed.column(c).to_numpy() for c in ("node", "n_rows", "error"))
    x, y = (unit(matrix(t.column("vector"), dim)) for t in (queries, listed))
    codes = np.frombuffer(b"".join(listed.column("code").to_pylist()), np.uint8).reshape(len(listed), -1)
    reach = math.sqrt(max(2 - 2 * cosine, 0.0))
    close = model.distances(x, place, codes) <= reach + error + ROUNDING
    # Within a list both sides hold every vector, so each pair is met once.
    close &= (q_list != place)[:, None] | (q_node[:, None] < l_node)
    i, j = np.nonzero(close)
    exact = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= cosine
    i, j = i[exact], j[exact]
    nodes = np.concatenate([q_node, l_node])
    links = np.concatenate([
        np.bincount(i, l_rows[j], len(q_node)).astype(np.int64), np.bincount(j, q_rows[i], len(l_node)).astype(np.int64)
    ])
    label = forest(i, j + len(q_node), len(nodes))
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes, links, nodes[tied], nodes[label[tied]]


def _links(placed: DataFrame, model: Quantiser, dim: int, cosine: float, far: float, scratch: Scratch) -> DataFrame:
    """(a, b, n): with null ``b`` a node and rows that it is linked with, else an edge of a block's forest."""
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                own = batch.column("own").to_numpy()
                near = shared.value.probes(unit(matrix(batch.column("vector"), dim)), own, far)
                near &= np.arange(near.shape[1]) >= own[:, None]  # the lower list asks the higher one
                row, place = np.nonzero(near)
                found = batch.take(pa.array(row))
                yield pa.record_batch(
                    [pa.array(place.astype(np.int64)), *(found.column(c) for c in ("node", "own", "n_rows", "vector"))],
                    names=["place", "node", "own", "n_rows", "vector"],
                )

    vector = f"vector {placed.schema['vector'].dataType.simpleString()}"
    asked = map_arrow(
        placed.select("node", "own", "n_rows", "vector"), probing,
        f"place long, node long, own long, n_rows long, {vector}",
    )
    asked = scratch.keep(asked, "probes", "probes")
    blocks = lambda rows, key, name: rows.groupBy(F.col(key).alias("place")).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name)
    )
    n_blocks = scratch.keep(blocks(asked, "place", "n_q").join(blocks(placed, "own", "n_l"), "place"), "blocks", "blocks")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(n_blocks, "place").withColumn("q", part("n_q")).withColumn("l", each("n_l"))
    right = placed.withColumnRenamed("own", "place").join(n_blocks, "place")
    right = right.withColumn("l", part("n_l")).withColumn("q", each("n_q"))
    key = ["place", "q", "l"]

    def compared(key, queries: pa.Table, listed: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not len(queries) or not len(listed):
            return none
        nodes, links, a, b = meet(shared.value, key[0].as_py(), queries, listed, dim, cosine)
        some = links > 0
        zeros = np.zeros(len(a), np.int64)
        return pa.table({
            "a": pa.array(np.concatenate([nodes[some], a])),
            "b": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(b, pa.int64())]),
            "n": pa.array(np.concatenate([links[some], zeros])),
        })

    ship(spark)
    met = (
        left.select(*key, "node", "own", "n_rows", "vector").groupBy(*key)
        .cogroup(right.select(*key, "node", "n_rows", "code", "error", "vector").groupBy(*key))
        .applyInArrow(compared, "a long, b long, n long")
    )
    links = scratch.keep(met, "links", "links")
    scratch.remove("probes", "blocks")
    return links


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, sure: float | None = SURE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing;
    a shorter vector counts as filled up with zeros.  Rows with equal vectors are linked, also
    when the whole row is repeated.  component_id is the smallest id that is reachable by links;
    null ids come last, and a component of null ids has a null component_id and keeps no row.
    An empty table gives no rows; other columns are ignored.  ``sure=None`` probes every list that
    can hold a partner, which no direction of the difference escapes.  ``cosine`` must lie above 0 and
    below 1.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.withColumn("vector", F.when(usable("vector"), F.col("vector")))
    keys = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")]
    held = rows.filter("vector is not null").select("vec_id", "vector", *keys)
    nodes = held.groupBy("k1", "k2", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n_rows"))
    scratch = Scratch(vectors.sparkSession)
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", "nodes")
    told = rows.select("vec_id", F.col("vector").isNull().alias("_alone"), *keys)
    n_nodes, dim = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n_nodes:
        return _report(told.withColumn("n_links", F.lit(0).cast("long")).withColumn("comp_id", F.col("vec_id")))
    sample = nodes.orderBy(F.xxhash64(F.lit(2), "vector"), "k1", "k2").limit(SAMPLE).select("vector").toArrow()
    model = fit(unit(matrix(sample.column(0), dim)), n_nodes)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                own, codes, error = shared.value.code(unit(matrix(batch.column("vector"), dim)))
                extra = [pa.array(own.astype(np.int64)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
                yield pa.record_batch([*batch.columns, *extra], names=[*batch.schema.names, "own", "code", "error"])

    schema = f"node long, n_rows long, vector {nodes.schema['vector'].dataType.simpleString()}"
    placed = map_arrow(nodes.select("node", "n_rows", "vector"), coded, f"{schema}, own long, code binary, error double")
    placed = scratch.keep(placed, "lists", "lists")
    share = 1.0 if sure is None else min(1.0, sure / math.sqrt(dim))
    met = _links(placed, model, dim, cosine, share * math.sqrt(2 - 2 * cosine) + 1e-9, scratch)
    links = met.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    members = components(met.filter("b is not null"))
    joined = nodes.select("node", "k1", "k2", "rep", "n_rows").join(members, "node", "left").join(links, "node", "left")
    joined = joined.withColumn("comp", F.coalesce("comp", "node"))
    least = joined.groupBy("comp").agg(F.min("rep").alias("comp_id"))
    classes = joined.join(least, "comp").select(
        "k1", "k2", "comp_id", (F.col("n_rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    classes = scratch.keep(classes, "classes")
    scratch.remove("lists", "links", "nodes")
    classes = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = told.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    told = told.join(classes, ["k1", "k2", "_salt"], "left").withColumn(
        "comp_id", F.when(F.col("_alone"), F.col("vec_id")).otherwise(F.col("comp_id"))
    )
    return _report(told.withColumn("n_links", F.when(F.col("_alone"), F.lit(0)).otherwise(F.col("n_links"))))


def _report(told: DataFrame) -> DataFrame:
    return told.select(
        "vec_id",
        F.col("n_links").cast("long").alias("n_links"),
        F.col("comp_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("comp_id"), F.lit(False)).alias("kept"),
    )
