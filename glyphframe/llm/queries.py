"""The registered queries of the training-data operators and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hilbert_ann, line_dedup, mixing, pii, simhash, suffix_dedup, topk, toxicity, url_filter
from .common import read_table


def tokenizer_files() -> tuple[str, str]:
    """The path of the vocabulary and its pattern, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.personal_data(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_files()
    return bpe.encode(read_table(spark, sf_dir, "documents"), path, pattern, columns=["doc_id"], keep_ids=False)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_ids(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_pii": op3_pii,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_url_filter": op6_url_filter,
    "op7_exact_topk": op7_exact_topk,
    "op8_toxicity": op8_toxicity,
    "op9_hilbert_ann": op9_hilbert_ann,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op7_exact_topk": topk.ORACLE_SQL,
    "op10_mixing": mixing.oracle_sql(),
}
