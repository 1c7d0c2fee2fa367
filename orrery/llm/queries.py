"""Queries over the driver's tables: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, fim, lines, lm, manifest, packing, quality, secrets, simhash, suffixes, toxicity
from .sql import OP1, OP6, OP7, OP9, OP11, OP13


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op2_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_context_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op6_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_schema_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], rows.schema)
    return chat.digest(chat.format_turn_rows(rows.unionByName(probe)))


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True, long_words=50)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return manifest.audit(_table(spark, sf_dir, "documents"), claim=(tampered, {"text": lowered}))


def op12_toxicity_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(_table(spark, sf_dir, "documents"), unit="codepoint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_block_matrix_ann,
        op2_knn_quality,
        op3_simhash_near_dedup,
        op4_hilbert_packing,
        op5_context_tree_lm,
        op6_credential_linking,
        op7_schema_chat_format,
        op8_qgram_decontamination,
        op9_winnowing_line_dedup,
        op10_suffix_array_dedup,
        op11_merkle_manifest,
        op12_toxicity_votes,
        op13_fill_in_middle,
    )
}
ORACLE: dict[str, str] = {
    op1_block_matrix_ann.__name__: OP1,
    op6_credential_linking.__name__: OP6,
    op7_schema_chat_format.__name__: OP7,
    op9_winnowing_line_dedup.__name__: OP9,
    op11_merkle_manifest.__name__: OP11,
    op13_fill_in_middle.__name__: OP13,
}
