"""Bit packing, whole-text encoding and the token store."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rotaloom.llm import token_binary as T

FILE = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = [
    "", None, " ", "a's I'll DON'T <|endoftext|>x<|startoftext|> y", "é é x\x0by ﬁ ΑΣ İstanbul\x00z \x1c k\x85l",
    "日本語 テキスト 123 4.5,6", "don’t ß ẞ ÅNGSTRÖM", "x" * 5000 + "!" * 50, "a.b,c ... ,,, a,.;", "́abc q́.", "<|ENDOFTEXT|>.",
    "word. word, word.. word., A. <|x|>",
]


@given(st.lists(st.integers(0, 2**13 - 1), max_size=300), st.integers(13, 31), st.integers(1, 64))
@settings(max_examples=40, deadline=None)
def test_image_round_trip_and_random_access(ids, bits, block):
    ids = np.array(ids, np.uint32)
    image = T.Image(T.build_image(ids, bits, block))
    assert (image.ids() == ids).all()
    low, high = len(ids) // 3, 2 * len(ids) // 3
    assert (image.ids(low, high) == ids[low:high]).all()


def test_fewest_bits():
    assert [T.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65537)] == [1, 1, 2, 8, 9, 16, 17]
    with pytest.raises(ValueError):
        T.build_image(np.array([256], np.uint32), 8)


def test_ids_are_those_of_the_library():
    library = Tokenizer.from_file(FILE)
    with open(FILE, "rb") as file:
        encoder = T.WordEncoder(file.read())
    for _ in range(2):  # the second time from the table
        ids, counts = encoder.encode(pa.array(ODD, pa.string()), 1)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [library.encode(t or "", add_special_tokens=False).ids + [1] for t in ODD]


def test_store(spark, tmp_path):
    library = Tokenizer.from_file(FILE)
    rows = [(i * 7 % 23, t) for i, t in enumerate(ODD)] + [(None, "lost"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as shard").repartition(3)
    path = str(tmp_path / "store")
    T.write_tokens(docs, path, FILE, 1, segment_ids=50)
    got = sorted((tuple(r) for r in T.read_documents(spark, path).collect()), key=lambda r: r[1])
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    everything = T.read_range(spark, path, 0, at)
    assert len(everything) == at and (T.read_range(spark, path, 40, 160) == everything[40:160]).all()


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "none")
    T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, FILE)
    assert T.read_documents(spark, path).count() == 0 and len(T.read_range(spark, path, 0, 10)) == 0
