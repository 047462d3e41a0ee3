"""Piece encoding: the library's ids without dropout, the agenda with it, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from rotaloom.llm import pieces as P

FILE = str(public_tokenizers.path("piece_bpe_32k.model"))
with open(FILE, "rb") as _file:
    TABLES = P.Pieces(_file.read())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)
ODD = ["", " ", "a", "  a  b   ", " " * 300 + "x", "a\n\n\tb\x00", "日本語テキスト 123", "😀 é", "x" * 500, "the" * 200, "<s> </s> <0x41>", "a" * 39]


def agenda(symbols, key, limit):
    """The plain form: look at all pairs again after every merge."""
    spans = [(s, i, i + 1) for i, s in enumerate(symbols)]
    while True:
        best = None
        for n, ((a, i, _), (b, j, end)) in enumerate(zip(spans, spans[1:])):
            piece = TABLES.pairs.get(a * (1 << 22) + b)
            if piece is None:
                continue
            place = (key + i * P._PLACE[0] + j * P._PLACE[1] + end * P._PLACE[2]) & P._MASK
            if limit and P._mix_int(place) < limit:
                continue
            if best is None or (TABLES.rank[piece], n) < best[:2]:
                best = (TABLES.rank[piece], n, piece)
        if best is None:
            return [s for s, _, _ in spans]
        _, n, piece = best
        spans[n : n + 2] = [(piece, spans[n][1], spans[n + 1][2])]


def split(ids, counts):
    return [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]


def test_without_dropout_as_the_library():
    ids, counts = TABLES.encode(ODD, np.arange(len(ODD), dtype=np.uint64))
    assert split(ids, counts) == [LIBRARY.encode(t) for t in ODD]


@given(st.lists(st.text(alphabet="ab the\n▁é😀0 in", max_size=60), max_size=6), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_lossless(texts, seed):
    keys = np.arange(len(texts), dtype=np.uint64)
    for rate in (0.0, 0.3, 1.0):
        ids, counts = TABLES.encode(texts, keys, rate, seed)
        assert [b.decode() for b in TABLES.decode(ids, counts)] == texts


@pytest.mark.parametrize("rate", [0.0, 0.2, 0.7])
def test_steps_and_heap_follow_the_agenda(rate):
    rng = random.Random(int(rate * 10))
    words = ["".join(rng.choice(" theinrao") for _ in range(rng.randrange(1, 15))) for _ in range(150)] + ["the in" * 30]
    segments = [[int(TABLES.symbol[ord(c)]) for c in w] for w in words]
    keys = np.array([rng.randrange(2**63) for _ in words], np.uint64)
    limit = int(rate * 2**64)
    flat, counts = TABLES.merge_all(np.concatenate(segments), np.array(list(map(len, segments))), keys, limit)
    assert split(flat, counts) == [agenda(s, int(k), limit) for s, k in zip(segments, keys)]
    assert split(flat, counts) == [TABLES.merge_heap(s, int(k), limit) for s, k in zip(segments, keys)]


def test_seeds_vary_and_repeat():
    text = ["the international organisation of the thing and the other thing"] * 2
    keys = np.array([3, 4], np.uint64)
    one, other = (TABLES.encode(text, keys, 0.3, seed) for seed in (1, 2))
    assert one[0].tolist() == TABLES.encode(text, keys, 0.3, 1)[0].tolist() != other[0].tolist()


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (3, "twice", "a"), (3, "twice", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string").repartition(3)
    assert all(r.lossless for r in P.round_trip(docs, FILE).collect())
    coded = P.encode(docs.drop("piece_ids").selectExpr("*", "1 as _key"), FILE)
    assert coded.columns == ["doc_id", "_key", "piece_ids", "n_pieces"]
    back = sorted(((r.doc_id, r.text) for r in P.decode(coded, FILE).collect()), key=str)
    assert back == sorted(((d, t or "") for d, t, _ in rows), key=str)
    assert P.encode(docs.limit(0), FILE).count() == 0


def test_every_occurrence_draws_for_itself():
    """More segmentations of a frequent word than the 16 that a stretch once had, each that of the plain agenda."""
    word, rate, seed = " internationalisation", 0.3, 7
    text = " " + word.strip() + word * 399
    keys = np.array([5, 6], np.uint64)
    symbols = [int(TABLES.symbol[ord(c)]) for c in word]
    ids, counts = TABLES.encode([text[1:]] * 2, keys, rate, seed)
    got = split(ids, counts)
    want, shown = [], set()
    for key in keys.tolist():
        base = P._mix_int(key ^ P._mix_int((seed * P._SECOND + 1) & P._MASK))
        parts = [agenda(symbols, P._mix_int((base + i * P._FIRST) & P._MASK), int(rate * 2**64)) for i in range(400)]
        shown |= {tuple(p) for p in parts}
        want.append([s for p in parts for s in p])
    assert got == want
    assert got[0] != got[1] and len(shown) > 16


def test_copies_draw_for_themselves(spark):
    text = "the international organisation of the thing and the other thing " * 5
    docs = spark.createDataFrame([(1, text, "x")] * 3 + [(2, "short", "y")], "doc_id long, text string, source string")
    one = sorted(tuple(r.piece_ids) for r in P.encode(docs.repartition(3), FILE).filter("doc_id = 1").collect())
    assert len(one) == len(set(one)) == 3
    assert one == sorted(tuple(r.piece_ids) for r in P.encode(docs.coalesce(1), FILE).filter("doc_id = 1").collect())


def test_a_batch_is_encoded_in_small_slices():
    """A batch has up to 10,000 texts; only some hundred kilobytes of them are Python strings and arrays at a time."""
    texts = [("ab c%d " % i) * 300 if i % 7 else None for i in range(900)] + ["x" * (2 * P.SLICE_BYTES)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(P._texts(batch, 1))
    assert [t for _, _, part in parts for t in part] == [t or "" for t in texts]
    assert all(high - low == len(part) for low, high, part in parts) and P.SLICE_BYTES <= 1 << 18
    assert all(len(part) == 1 or sum(map(len, part)) <= P.SLICE_BYTES for _, _, part in parts) and len(parts) > 5
