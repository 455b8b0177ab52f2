"""From raw documents to token ids: the stages of a training corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphframe.llm import bpe, line_dedup, mixing, simhash, toxicity
from glyphframe.llm.common import read_table, release, written
from glyphframe.llm.queries import tokenizer_files

#: SQL can express neither the scores of texts nor the token ids; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{x}`") for x in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on the labels finds toxic go. Null and empty texts stay."""
    release(spark)  # what earlier work has left
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return same_columns(toxicity.toxicity(docs, model).where("predicted = 0"), docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in three documents or more stay in one only; n_chars follows. A document that loses all its lines stays, empty."""
    kept = line_dedup.line_dedup(docs).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return same_columns(kept, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose shingles of five words are 0.8 similar, the one with the smallest id stays."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domain, language and source ask for."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, ids_sha256, decoded_sha256) of each document."""
    path, pattern = tokenizer_files()
    return bpe.encode(docs, path, pattern, columns=["doc_id", "lang", "source"], remember=1 << 15)  # workers have held other stages before


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_shared_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns, each stage having been written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
