"""op3: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.near_dedup import groups

NAME = "op3_minhash_near_dedup"
WIDTH, PERCENT = 4, 80


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), WIDTH, PERCENT)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.expr("coalesce(doc = component, true)").alias("kept"))


def near_sql(table: str, width: int, percent: int) -> str:
    """CTEs that give ``near(doc_id, n_shingles, component_id)`` for ``table(doc_id, text)``; exact, all links."""
    grams = " || ' ' || ".join(f"ws[i + {k}]" for k in range(1, width + 1))
    return f"""
near_words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM {table}),
near_grams AS (SELECT DISTINCT doc_id, {grams} AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {width - 1})) AS i FROM near_words WHERE len(ws) >= {width})
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM near_words WHERE len(ws) BETWEEN 1 AND {width - 1}),
near_sizes AS (SELECT doc_id, count(*) AS n FROM near_grams GROUP BY doc_id),
near_common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM near_grams x JOIN near_grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
near_links AS (SELECT a, b FROM near_common JOIN near_sizes p ON a = p.doc_id JOIN near_sizes q ON b = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
near_both AS (SELECT a, b FROM near_links UNION ALL SELECT b, a FROM near_links),
near_reach(doc_id, r) AS (SELECT doc_id, doc_id FROM {table} UNION SELECT e.b, r FROM near_reach JOIN near_both e ON near_reach.doc_id = e.a),
near AS (SELECT t.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM {table} t JOIN near_reach USING (doc_id) LEFT JOIN near_sizes s USING (doc_id) GROUP BY t.doc_id)"""


ORACLE = f"WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {near_sql('docs', WIDTH, PERCENT)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near"
