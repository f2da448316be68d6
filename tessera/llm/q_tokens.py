"""op11: tokens of all documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.token_counts import count

NAME = "op11_token_counts"
VOCABULARY = os.environ.get("TESSERA_TOKENS", "/opt/tokenizers/word_bpe_49k.json")
MOST = 2048


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count(docs, VOCABULARY).select(F.col("doc").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > MOST).alias("over_limit"))
