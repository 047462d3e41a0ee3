"""Queries of this subpackage and their SQL statements."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rotaloom.llm import (
    exact_dedup,
    group_join,
    language_id,
    lexical,
    main_text,
    mixing,
    personal_data,
    pieces,
    quality,
    substring_dedup,
    token_binary,
    vector_codes,
    vector_join,
)
from rotaloom.llm.common import documents
from rotaloom.plans.scratch import folder

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Where the box keeps its public tokenizers; any other path works as well."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/rotaloom/tokens-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir).select("doc_id", "text")
    token_binary.write_tokens(docs, path, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_binary.read_documents(spark, path)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pieces.round_trip(docs, tokenizer_file("piece_bpe_32k.model"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = group_join.jaccard_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return groups.select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.shares(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.withColumn("position", F.round("position", 9))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(documents(spark, sf_dir).select("doc_id", "text"))


def op11_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return lexical.rank(documents(spark, sf_dir).select("doc_id", "text"), items)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_token_binary": op1_token_binary,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_language_id": op5_language_id,
        "op6_pieces": op6_pieces,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_mixing": op8_mixing,
        "op9_main_text": op9_main_text,
        "op10_personal_data": op10_personal_data,
        "op11_vector_join": op11_vector_join,
        "op12_vector_codes": op12_vector_codes,
        "op13_lexical_search": op13_lexical_search,
        "pipeline": pipeline,
    }
