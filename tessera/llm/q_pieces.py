"""op4: pieces of all documents, with their decoding tested."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.sentencepiece_codec import encode

NAME = "op4_sentencepiece"
MODEL_FILE = os.environ.get("TESSERA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, MODEL_FILE).select(F.col("doc").alias("doc_id"), "ids", "n_ids", "n_byte_ids", "round_trip")
