"""From raw documents to a mixed, encoded training stream, in five stages.

Each stage is a function of the session, the rows that its predecessor kept and the
folder of the tables, and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each result to the shared folder and reads it back, so a
lost executor costs at most the stage it was working on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaloom.llm import exact_dedup, group_join, language_id, mixing, pieces
from rotaloom.llm.common import documents, materialize, pack

PIECE_MODEL = "piece_bpe_32k.model"
# A text is rejected unless its language stands out from an even guess by this factor.
STANDS_OUT = 1.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters and foreign scripts go.

    Where no document outside the held-out fold names its language there is no model,
    and all texts with a letter stay.
    """
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    packed, restored = pack(docs, ["doc_id", "text"])
    told = language_id.identify(packed, "text", model)
    least = STANDS_OUT / len(model.languages) if len(model.languages) > 1 else 0.0
    known = (F.col("lang_pred") != language_id.UNDECIDED) & (F.col("score") >= least)
    return told.filter(known).select(*restored)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a shingle similarity of 0.8 on five words, that with the smallest doc_id."""
    return group_join.keep_one(docs, gram=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as the mix takes them, sorted by training position.

    The columns of ``documents`` have no room for the position, so the order lives in the
    rows of this DataFrame and in the order of the part files it is written to.
    """
    packed, restored = pack(docs, ["doc_id", "text", "source"])
    return mixing.mix(packed).select(*restored)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with seeded merge-dropout instead of the text."""
    import public_tokenizers

    return pieces.encode(docs, str(public_tokenizers.path(PIECE_MODEL)))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

# Language identification, dropout and decoding have no SQL form; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
