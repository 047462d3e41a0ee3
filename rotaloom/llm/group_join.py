"""N-gram Jaccard join through a token-group matrix.

A document is the set of its distinct word n-grams, kept as 64-bit hashes.  Equal
sets become one node, so copies cost nothing further.  The join then finds which
nodes are linked (100 * |intersection| >= percent * |union|) and returns connected
groups, in these steps, none of which loses a link between different texts:

1.  Order all grams, rare ones first.  Linked sets share a gram among the first
    n - ceil(percent * n / 100) + 1 of each, so only those grams are posted.  Any
    fixed order is right; the frequent grams that tasks report are put last so that
    no common line opens a posting.
2.  Partition similar nodes into groups: within each posting every node is compared
    with one pivot, and linked nodes form groups.  A few rounds with other pivots join
    most of what belongs together at a cost of one comparison per node and round.
    Postings with the same nodes, as those of near copies, count as one.
3.  The groups are the rows of the token-group matrix, and the cells of the gram space its
    columns.  A set's i-th gram in a cell counts as the coarse token (cell, i), so the union of a
    group's coarse tokens is the largest count of any member in each cell, and the sum over cells of the
    smaller of that and the query's count bounds the query's overlap with every member.  Within each
    posting a node asks the groups that it is not in (a node without links is a group of its
    own); only groups of fitting sizes whose bound reaches percent of the query are opened, and
    their members are held to the same bound one by one.  Large postings meet in blocks, so no
    pair is a row before it has passed.
4.  New links join the groups.

The same cell counts bound the overlap of two sets.  Sixty-four cells tell little about long texts, so a set
also has marks: the parity of its grams in each of at least as many slots as it has grams.
Each gram that only one of two sets holds changes one bit at most, so the bits in which they differ bound the
overlap from above at any length.  Texts are fetched and compared in full only for pairs
that pass both bounds, and for each pair only once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.llm.common import (
    batches_of,
    chunks,
    gram_hashes,
    map_arrow,
    materialize,
    pack,
    ship,
    slices,
    text_or_empty,
    word_hashes,
    word_spans,
)
from rotaloom.llm.components import components
from rotaloom.plans.scratch import Scratch

GRAM, PERCENT = 3, 90
CELLS = 64
# Bytes of a set's marks, least and most, and bytes of marks that are compared at a time.
LEAST_MARKS, MOST_MARKS, MARK_BYTES = 16, 4096, 16 << 20
LOCAL_BYTES, LOCAL_COUNT = 8 << 20, 3
FREQUENT_GRAMS = 300_000
STAR_ROUNDS = 3
# Nodes of a block, rows of a task's table and pairs that are bounded at a time.
GROUP, TABLE_ROWS, PAIRS = 2048, 8192, 1 << 16
# Postings that a row of the matrix names, so that pairs which share many are not reported by each.
LOWEST = 4
BROADCAST_ROWS = 500_000
BATCH_ROWS = 1_000
SALTS = 8


# -- sets --------------------------------------------------------------------
def gram_sets(texts: pa.Array, gram: int = GRAM) -> Iterator[np.ndarray]:
    """The sorted distinct gram hashes of each text; a text of fewer words is one gram, one without words has none."""
    for _, data, offsets in chunks(texts):
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        starts, ends, reach = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        grams = gram_hashes(words, gram)
        for low, high in zip(reach[:-1].tolist(), reach[1:].tolist()):
            if high - low >= gram:
                yield np.unique(grams[low : high - gram + 1])
            elif high > low:
                yield gram_hashes(words[low:high], high - low)
            else:
                yield grams[:0]


def cell_counts(grams: np.ndarray) -> np.ndarray:
    return np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=CELLS).astype("<u4")


def stored_cells(counts: np.ndarray) -> bytes:
    """One byte a cell, or four where a count needs them."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<u4").tobytes()


def cells_of(stored: list[bytes]) -> np.ndarray:
    """A row of cell counts for each stored one."""
    out = np.empty((len(stored), CELLS), np.uint32)
    narrow = np.fromiter((len(s) == CELLS for s in stored), bool, len(stored))
    out[narrow] = np.frombuffer(b"".join(s for s in stored if len(s) == CELLS), np.uint8).reshape(-1, CELLS)
    out[~narrow] = np.frombuffer(b"".join(s for s in stored if len(s) != CELLS), "<u4").reshape(-1, CELLS)
    return out


def marks_of(grams: np.ndarray) -> bytes:
    """Whether the number of grams in each slot is odd, one bit a slot; the slots are a power of two."""
    slots = 8 * min(MOST_MARKS, max(LEAST_MARKS, 1 << ((len(grams) - 1) // 8).bit_length()))
    slot = (grams >> np.uint64(32)) & np.uint64(slots - 1)
    return np.packbits(np.bincount(slot.astype(np.int64), minlength=slots) & 1).tobytes()


def folded(stored: list[bytes], width: int) -> np.ndarray:
    """Marks as rows of ``width`` bytes: slots that coincide there add up, which is the exclusive or of their parities."""
    out = np.empty((len(stored), width), np.uint8)
    sizes = np.fromiter(map(len, stored), np.int64, len(stored))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        same = np.frombuffer(b"".join(stored[i] for i in at.tolist()), np.uint8).reshape(len(at), size // width, width)
        out[at] = np.bitwise_xor.reduce(same, axis=1)
    return out


def least_unlike(stored: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows of ``stored`` a number of grams that at least are in one of the two sets only."""
    sizes = np.fromiter(map(len, stored), np.int64, len(stored))
    width = np.minimum(sizes[left], sizes[right])
    out = np.zeros(len(left), np.int64)
    for size in np.unique(width).tolist():
        at = np.flatnonzero(width == size)
        step = MARK_BYTES // size
        for first in range(0, len(at), step):
            k = at[first : first + step]
            used, place = np.unique(np.concatenate([left[k], right[k]]), return_inverse=True)
            rows = folded([stored[i] for i in used.tolist()], size)
            out[k] = np.bitwise_count(rows[place[: len(k)]] ^ rows[place[len(k) :]]).sum(axis=1, dtype=np.int64)
    return out


def may_link(stored: list[bytes], left: np.ndarray, right: np.ndarray, n_a, n_b, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of rows of ``stored`` have marks that leave room for a link."""
    return linked((n_a + n_b - least_unlike(stored, left, right)) // 2, n_a, n_b, percent)


def linked(common: np.ndarray | int, n_a, n_b, percent: int = PERCENT):
    return 100 * common >= percent * (n_a + n_b - common)


def needed(n, percent: int = PERCENT):
    """The least overlap of a set of ``n`` grams with any set that it is linked with."""
    return -(-percent * n // 100)


def _frequent(docs: DataFrame, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams that most documents hold, sorted, with their rank; at most FREQUENT_GRAMS.

    Tasks report grams that LOCAL_COUNT different sets among LOCAL_BYTES of text hold.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(0), LOCAL_BYTES):
                sets = gram_sets(batch.column(0).slice(low, high - low), gram)
                unlike = {hashlib.blake2b(s.tobytes(), digest_size=16).digest(): s for s in sets if len(s)}
                if not unlike:
                    continue
                found, n = np.unique(np.concatenate(list(unlike.values())), return_counts=True)
                often = n >= LOCAL_COUNT
                yield pa.record_batch(
                    [pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["gram", "n"]
                )

    counted = map_arrow(docs.select("text"), local, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "gram").limit(FREQUENT_GRAMS).toArrow()
    grams = top.column("gram").to_numpy().view(np.uint64)
    by_gram = np.argsort(grams)
    return grams[by_gram], (len(top) - np.arange(len(top)))[by_gram]  # the most frequent ranks last


def posted(grams: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first grams of a set in the common order: rare ones by hash, then frequent ones."""
    n = len(grams)
    most = n - needed(n, percent) + 1
    if not len(frequent):
        return grams[:most]
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    known = frequent[at] == grams
    first = grams[~known][:most]
    if len(first) < most:
        later = grams[known][np.argsort(rank[at[known]], kind="stable")]
        first = np.concatenate([first, later[: most - len(first)]])
    return first


def _sets(docs: DataFrame, gram: int, percent: int) -> DataFrame:
    """Per row: doc_id, hash of the text, n_shingles, digest of the set, cell counts, marks, posted grams."""
    frequent, rank = _frequent(docs, gram)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, rank))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        for batch in batches:
            n, digests, cells, marks, first = [], [], [], [], []
            for grams in gram_sets(batch.column(2), gram):
                n.append(len(grams))
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                cells.append(stored_cells(cell_counts(grams)))
                marks.append(marks_of(grams))
                first.append(posted(grams, frequent, rank, percent).view(np.int64))
            ends = np.cumsum([0, *map(len, first)])
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate(first) if first else np.empty(0, np.int64))
            )
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(cells, pa.binary()), pa.array(marks, pa.binary()), lists],
                names=["doc_id", "text_hash", "n", "digest", "cells", "marks", "first"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), "text")
    return map_arrow(
        rows,
        described,
        "doc_id long, text_hash long, n long, digest binary, cells binary, marks binary, first array<bigint>",
    )


# -- comparing ---------------------------------------------------------------
def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b, cells_a, cells_b) whose cell counts leave room for a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = [cells_of(batch.column(c).to_pylist()) for c in ("cells_a", "cells_b")]
            most = np.minimum(*cell).sum(axis=1, dtype=np.int64)
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            yield batch.filter(pa.array(linked(most, n_a, n_b, percent))).select(["a", "b"])

    return map_arrow(pairs, keep, "a long, b long")


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose marks leave room for a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = [s for c in ("marks_a", "marks_b") for s in batch.column(c).to_pylist()]
            left = np.arange(batch.num_rows)
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            good = may_link(stored, left, left + batch.num_rows, n_a, n_b, percent)
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return map_arrow(_sized(pairs, nodes, "marks"), keep, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, gram: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked; only texts of nodes in a pair are read and shipped."""
    pairs = scratch.keep(_close(pairs, nodes, percent), "close", "close")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keys = wanted.join(nodes.select("node", "rep"), "node").select(
        "node", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash")
    )
    keys = scratch.keep(keys, "wanted", "wanted")
    if keys.count() <= BROADCAST_ROWS:  # a checked size; beyond it both sides are dealt out
        keys = F.broadcast(keys)
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), text_or_empty().alias("text")).withColumn(
        "_text_hash", F.xxhash64("text")
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    texts = scratch.keep(rows.join(keys, same).select("node", "text"), "texts", "texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_sets(batch.column(c), gram) for c in ("text_a", "text_b")]
            good = [
                bool(linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent)) for a, b in zip(*sets)
            ]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    text = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    found = map_arrow(pairs.join(text("a"), "a").join(text("b"), "b"), compare, "a long, b long").distinct()
    # A row holds two whole texts, which JVM and Python both buffer by the batch.
    with batches_of(docs.sparkSession, BATCH_ROWS):
        found = scratch.keep(found, "found")
    scratch.remove("close", "wanted", "texts")
    return found


def _sized(pairs: DataFrame, sizes: DataFrame, fact: str = "cells") -> DataFrame:
    side = lambda s: sizes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col(fact).alias(f"{fact}_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


# -- the matrix --------------------------------------------------------------
def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each of the ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def open_groups(t: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Row numbers of queries and members of other groups that may be linked, groups asked and groups opened.

    ``t`` has rows (gram, q, g, block, node, n, comp, cells) ordered by gram, q, g and comp: block q of the posting ``gram`` asks
    the groups in its block g.
    """
    key = np.cumsum(np.r_[False, (np.diff(t["gram"]) != 0) | (np.diff(t["q"]) != 0) | (np.diff(t["g"]) != 0)])
    n, node, comp, cells = (t[c] for c in ("n", "node", "comp", "cells"))
    members = np.flatnonzero(t["block"] == t["g"])
    asking = np.flatnonzero(t["block"] == t["q"])
    none = np.empty(0, np.int64)
    if not len(members) or not len(asking):
        return none, none, 0, 0
    begins = np.flatnonzero(np.r_[True, (np.diff(key[members]) != 0) | (np.diff(comp[members]) != 0)])
    sizes = np.diff(np.r_[begins, len(members)])
    union = np.maximum.reduceat(cells[members], begins)
    low, high = np.minimum.reduceat(n[members], begins), np.maximum.reduceat(n[members], begins)
    of_group, of_comp = key[members[begins]], comp[members[begins]]
    from_, to = (np.searchsorted(of_group, key[asking], side) for side in ("left", "right"))
    reach = np.cumsum(to - from_)
    left, right, asked, opened = [none], [none], 0, 0
    at = 0
    while at < len(asking):
        last = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS, side="right")))
        i = np.repeat(asking[at:last], to[at:last] - from_[at:last])
        j = _ranges(from_[at:last], to[at:last] - from_[at:last])
        other = of_comp[j] != comp[i]
        i, j = i[other], j[other]
        asked += len(i)
        fits = (needed(n[i], percent) <= high[j]) & (needed(low[j], percent) <= n[i])
        i, j = i[fits], j[fits]
        some = np.minimum(cells[i], union[j]).sum(axis=1, dtype=np.int64) >= needed(n[i], percent)
        i, j = i[some], j[some]
        opened += len(i)
        at = last
        if not len(i):
            continue
        # Opened groups are unfolded to about PAIRS members at a time, however many groups open at once.
        unfolded = np.cumsum(sizes[j])
        low_j = 0
        while low_j < len(j):
            high_j = max(low_j + 1, int(np.searchsorted(unfolded, (unfolded[low_j - 1] if low_j else 0) + PAIRS, side="right")))
            groups = j[low_j:high_j]
            m = members[_ranges(begins[groups], sizes[groups])]
            k = np.repeat(i[low_j:high_j], sizes[groups])
            low_j = high_j
            # Within one block both sides hold every node, so each pair is met once.
            once = (t["q"][k] != t["g"][k]) | (node[k] < node[m])
            k, m = k[once], m[once]
            most = np.minimum(cells[k], cells[m]).sum(axis=1, dtype=np.int64)
            good = linked(most, n[k], n[m], percent)
            left.append(k[good])
            right.append(m[good])
    return np.concatenate(left), np.concatenate(right), asked, opened


def lowest_of(stored: list[list[int]]) -> np.ndarray:
    """A row of LOWEST postings for each stored list; the highest number stands for none."""
    out = np.full((len(stored), LOWEST), np.iinfo(np.int64).max)
    for i, grams in enumerate(stored):
        out[i, : len(grams)] = grams
    return out


def first_meetings(gram: np.ndarray, lowest: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows do not share a lower posting among the lowest of both, where they would be reported already.

    A pair that shares one of these is reported once, any other once for each posting that it shares.
    """
    new = np.ones(len(left), bool)
    for first in range(0, len(left), PAIRS):
        i, j = left[first : first + PAIRS], right[first : first + PAIRS]
        earlier = np.where(lowest[i] < gram[i][:, None], lowest[i], np.iinfo(np.int64).min)
        known = (earlier[:, :, None] == lowest[j][:, None, :]) & (earlier[:, :, None] > np.iinfo(np.int64).min)
        new[first : first + PAIRS] = ~known.any(axis=(1, 2))
    return new


def _met(placed: DataFrame, sizes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes in different groups that share a posting and pass the bounds."""
    mixed = placed.groupBy("gram").agg(
        F.count(F.lit(1)).alias("k"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    blocks = F.ceil(F.col("k") / GROUP).cast("int").alias("blocks")
    mixed = scratch.keep(mixed.filter("low < high").select("gram", "k", blocks), "mixed", "mixed")
    rows = scratch.keep(placed.join(mixed.select("gram", "blocks"), "gram"), "rows", "members")
    lowest = F.slice(F.sort_array(F.collect_list("gram")), 1, LOWEST).alias("lowest")
    facts = scratch.keep(sizes.select("node", "cells", "marks").join(rows.groupBy("node").agg(lowest), "node"), "facts", "facts")
    n_rows = mixed.agg(F.sum(F.col("k") * F.col("blocks"))).first()[0] or 0
    tables = max(1, -(-n_rows // TABLE_ROWS))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meeting = (
        rows.withColumn("block", block)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("q", F.least("block", "_other"))
        .withColumn("g", F.greatest("block", "_other"))
        .join(facts, "node")
        .select(F.pmod(F.xxhash64("gram", "q", "g"), F.lit(tables)).alias("table"),
                "gram", "q", "g", "block", "node", "n", "comp", "cells", "marks", "lowest")
    )

    def compared(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_numpy() for c in ("gram", "q", "g", "block", "node", "n", "comp")}
        order = np.lexsort((t["comp"], t["g"], t["q"], t["gram"]))
        t = {c: x[order] for c, x in t.items()}
        t["cells"] = cells_of(table.column("cells").to_pylist())[order]
        a, b, _, _ = open_groups(t, percent)
        new = first_meetings(t["gram"], lowest_of(table.column("lowest").to_pylist())[order], a, b)
        a, b = a[new], b[new]
        marks = table.column("marks").to_pylist()
        near = may_link(marks, order[a], order[b], t["n"][a], t["n"][b], percent)
        a, b = t["node"][a[near]], t["node"][b[near]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    ship(placed.sparkSession)
    found = meeting.groupBy("table").applyInArrow(compared, "a long, b long").distinct()
    found = scratch.keep(found, "more", "more")
    scratch.remove("mixed", "members", "facts")
    return found


# -- the join ----------------------------------------------------------------
def _grouped(docs: DataFrame, gram: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The set of each row, and per digest that is copied or linked: component_id and its representative row."""
    scratch = Scratch(docs.sparkSession)
    sets = _sets(docs, gram, percent)
    with batches_of(docs.sparkSession, BATCH_ROWS):
        sets = scratch.keep(sets, "sets", "sets")
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    nodes = (
        sets.filter("n > 0")
        .groupBy("digest")
        .agg(*[F.first(c).alias(c) for c in ("n", "cells", "marks", "first")], F.min(key).alias("rep"),
             F.count(F.lit(1)).alias("n_rows"))
    )
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", "nodes")
    # From here on a row needs no more than its key and its set's digest.
    light = materialize(sets.select("doc_id", "text_hash", "n", "digest"), "rows")
    scratch.remove("sets")
    sets = light
    sizes = nodes.select("node", "n", "cells", "marks")

    # Postings that more than one node shares; of those with the same nodes one is enough.
    postings = nodes.select("node", "n", F.explode("first").alias("gram"))
    once, again = F.xxhash64("node"), F.xxhash64(F.lit(1), "node")
    repeated = postings.groupBy("gram").agg(
        F.count(F.lit(1)).alias("k"), F.min("node").alias("m"), F.bit_xor(once).alias("x"), F.bit_xor(again).alias("y")
    )
    unlike = repeated.filter("k > 1").groupBy("k", "m", "x", "y").agg(F.min("gram").alias("gram")).select("gram")
    unlike = scratch.keep(unlike, "grams", "grams")
    if unlike.count() <= BROADCAST_ROWS:  # a checked size; beyond it the postings are dealt out once more
        unlike = F.broadcast(unlike)
    shared = scratch.keep(postings.join(unlike, "gram"), "postings", "postings")
    scratch.remove("grams")

    # Groups of similar nodes, by comparing with pivots.  Pairs that were compared are not compared again.
    links = done = members = None
    placed = shared.withColumn("comp", F.col("node"))
    for turn in range(STAR_ROUNDS):
        order = F.xxhash64(F.lit(turn), "node") if turn else F.col("node")
        pivots = placed.groupBy("gram").agg(
            F.min(F.struct(order.alias("o"), F.col("node").alias("pivot"), F.col("comp").alias("home"))).alias("p")
        )
        star = placed.join(pivots.select("gram", "p.pivot", "p.home"), "gram").filter("comp <> home")
        star = star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        if done is not None:
            star = star.join(done, ["a", "b"], "left_anti")
        near = scratch.keep(_bounded(_sized(star, sizes), percent), "near")
        done = near if done is None else done.union(near)
        found = _verified(near, docs, nodes, gram, percent, scratch)
        if turn and found.isEmpty():
            break
        links = found if links is None else links.union(found)
        members = components(links)
        placed = shared.join(members, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        placed = scratch.replace(placed.select("gram", "node", "n", "comp"), "placed")

    # Every node against the groups of others that it shares a posting with.
    more = _met(placed, sizes, percent, scratch).join(done, ["a", "b"], "left_anti")
    if not more.isEmpty():
        links = links.union(_verified(more, docs, nodes, gram, percent, scratch))
        members = components(links)

    joined = nodes.select("node", "digest", "rep", "n_rows").join(members, "node", "left")
    joined = joined.filter("n_rows > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "node"))
    best = joined.groupBy("comp").agg(F.min("rep").alias("best"))
    classes = materialize(joined.join(best, "comp").select("digest", "best"), "classes")
    scratch.remove(*list(scratch.paths))
    return sets, classes


def jaccard_groups(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, is_first.

    component_id is the smallest doc_id that is reachable by links, null doc_ids being
    last; ``is_first`` marks the row that speaks for its group.  Null and wordless
    texts have no shingles, link with nothing and form groups of their own.  Repeated
    rows are linked as equal sets, and all rows equal to the first one are marked.  An
    empty table gives no rows; other columns are ignored.
    """
    sets, classes = _grouped(docs, gram, percent)
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int")
    spread = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = sets.select("doc_id", "text_hash", "n", "digest", salt("doc_id", "text_hash").alias("_salt"))
    rows = rows.join(spread, ["digest", "_salt"], "left")
    alone = F.col("best").isNull()
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(same).alias("is_first"),
        "text_hash",
    )


def keep_one(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that speak for their group, with all their columns."""
    told = jaccard_groups(docs, gram, percent)
    dropped = told.filter("not is_first").select(
        F.col("doc_id").alias("_dropped_id"), F.col("text_hash").alias("_dropped_hash")
    )
    dropped = materialize(dropped.distinct(), "dropped")
    packed, restored = pack(docs, ["doc_id", "text"])
    same = F.col("doc_id").eqNullSafe(F.col("_dropped_id")) & (F.xxhash64(text_or_empty()) == F.col("_dropped_hash"))
    return packed.join(dropped, same, "left_anti").select(*restored)
