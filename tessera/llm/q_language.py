"""op8: the language of all documents, learned from those whose crc32(doc_id) mod 3 is not 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.language_id import fit, predict

NAME = "op8_language_id"
FOLD = "coalesce(crc32(cast(cast({} AS string) AS binary)) % 3 = 1, false)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learned = docs.where("doc_id IS NOT NULL").where(~F.expr(FOLD.format("doc_id")))
    model = fit(learned.select("lang", "text", F.col("doc_id").alias("key")), F.col("key"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select(F.col("doc").alias("doc_id"), F.expr(FOLD.format("doc")).alias("held_out"), "lang_pred", "score", "rejected")
