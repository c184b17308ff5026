"""The registered query of every operator of this package."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import (
    alignment, byte_bpe, decontaminate, katz, licenses, line_dedup, mixing, personal_data, quality_rules, shingle_join, spelling, suffix_dedup, topk_search,
)
from tidepanel.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.reported(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.found(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.reported(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    ranks = byte_bpe.load_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, "text", ranks).select("doc_id", "digest.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.reported(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    files = [Path(given or public_tokenizers.path(name)).read_bytes() for given, name in ((a, "byte_bpe_50k.json"), (b, "piece_bpe_32k.model"))]
    return alignment.reported(table(spark, sf_dir, "documents"), alignment.Vocabularies(*files, public_tokenizers.PATTERN))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_shingle_join": op3_shingle_join,
    "op4_topk_search": op4_topk_search,
    "op5_personal_data": op5_personal_data,
    "op6_katz": op6_katz,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_licenses": op8_licenses,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_mixing": op10_mixing,
    "op11_decontaminate": op11_decontaminate,
    "op12_alignment": op12_alignment,
    "op13_spelling": op13_spelling,
}
ORACLE: dict[str, str] = {}
