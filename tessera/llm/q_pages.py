"""op6: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.html_extraction import main_text

NAME = "op6_html_extraction"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
