"""The corpus pipeline: documents in, encoded documents out; each stage's result is written and read again.

All stages but the last return the columns of ``documents``; the last returns (doc_id, ids, n_ids, n_byte_ids,
round_trip).  No SQL: the fourth stage's search and the last one's Viterbi cannot be expressed in it; the tests hold
the whole pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, line_dedup, near_dedup, quality_rules, sentencepiece_codec
from tessera.llm.common import materialise
from tessera.llm.q_pieces import MODEL_FILE

NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own base rule and whose host is not rejected."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines under repeated three-line windows."""
    return line_dedup.edit_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, and all that are in none."""
    return near_dedup.filter_documents(docs, NEAR_WORDS, NEAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids."""
    return sentencepiece_codec.encode(docs, MODEL_FILE).select(F.col("doc").alias("doc_id"), "ids", "n_ids", "n_byte_ids", "round_trip")


STAGES = [("quality rules", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("benchmark decontamination", benchmark), ("SentencePiece", pieces)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k}")
    return docs
