"""op7: licences of all documents, as files of a tree.

``documents`` has no paths.  Here a document lies at <source>/<doc_id div 1000>/<doc_id div 20>/<doc_id>.txt, and every
twentieth one is its directory's LICENSE file, every thousandth its parent's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.license_scan import scan

NAME = "op7_license_scan"
PATH = """CASE WHEN doc_id % 1000 = 0 THEN concat_ws('/', source, doc_id div 1000, 'LICENSE')
  WHEN doc_id % 20 = 0 THEN concat_ws('/', source, doc_id div 1000, doc_id div 20, 'LICENSE')
  ELSE concat_ws('/', source, doc_id div 1000, doc_id div 20, concat(doc_id, '.txt')) END"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(PATH).alias("path"), "text")
    return scan(docs, "doc_id").withColumnRenamed("file", "doc_id")
