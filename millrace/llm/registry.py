"""Queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import oracles
from millrace.llm.byte_bpe import token_digests
from millrace.llm.fill_middle import middle_digests
from millrace.llm.html_text import main_text
from millrace.llm.matroska import store_documents
from millrace.llm.mixing import mix
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.packing import pack_documents
from millrace.llm.quality import score_documents
from millrace.llm.resampling import resample
from millrace.llm.secret_scan import scan_secrets
from millrace.llm.substring_dedup import remove_repeats
from millrace.llm.token_counts import section_tokens
from millrace.llm.warc import derive, read_records, responses


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir))


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_documents(_documents(spark, sf_dir))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_pages(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(read_records(responses(_pages(spark, sf_dir)), key="page_id"), with_record=False)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=4)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_cascade": op2_quality_cascade,
    "op3_matroska": op3_matroska,
    "op4_html_main_text": op4_html_main_text,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pack": op6_pack,
    "op7_section_tokens": op7_section_tokens,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_secret_scan": op9_secret_scan,
    "op10_near_dedup": op10_near_dedup,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_importance_resample": op12_importance_resample,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op2_quality_cascade": oracles.QUALITY,
    "op5_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op9_secret_scan": oracles.SECRET_SCAN,
    "op12_importance_resample": oracles.RESAMPLING,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
