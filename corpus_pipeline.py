"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but
the last return the columns of documents; ``n_chars`` follows the text where a stage cuts it.
Stages handle nulls, empty and very long texts, repeated rows, empty tables and extra columns
as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm import decontaminate, language_id, sentence_pieces, simhash_dedup, substring_dedup
from quizloom.llm.common import stored
from quizloom.session import configure


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    return language_id.language_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id."""
    return simhash_dedup.simhash_filter(docs, shingle=simhash_dedup.SHINGLE, distance=simhash_dedup.DISTANCE)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 35 words that start elsewhere as well are cut; documents with nothing left go."""
    return _recounted(substring_dedup.substring_dedup_filter(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single benchmark passages are cut from the others."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _recounted(decontaminate.decontaminate_filter(docs, bench))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and the SentencePiece ids of the text."""
    return sentence_pieces.piece_encode(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", repeats),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", tokens),
]

#: Language ID and near-dedup have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
