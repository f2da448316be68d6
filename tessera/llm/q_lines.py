"""op1: line dedup of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.line_dedup import dedup

NAME = "op1_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "_l.n_lines", "_l.n_removed", "_l.text")


def lines_sql(table: str) -> str:
    """CTEs that give ``lines_kept(doc_id, n_lines, n_removed, text)`` for ``table(doc_id, text)``."""
    return f"""
line_rows AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {table} WHERE text IS NOT NULL))),
line_windows AS (SELECT doc_id, i, line || chr(10) || b || chr(10) || c AS w FROM (SELECT doc_id, i, line, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM line_rows WINDOW d AS (PARTITION BY doc_id ORDER BY i)) WHERE c IS NOT NULL),
line_later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM line_windows WHERE regexp_matches(w, '[^\\x20\\x09-\\x0D]')) WHERE k > 1),
line_gone AS (SELECT DISTINCT doc_id, i + k AS i FROM line_later, range(0, 3) r(k)),
lines_kept AS (SELECT t.doc_id, coalesce(max(n), 0) AS n_lines, coalesce(max(g), 0) AS n_removed, CASE WHEN t.text IS NOT NULL THEN coalesce(max(kept), '') END AS text
  FROM {table} t LEFT JOIN (SELECT r.doc_id, count(*) AS n, count(g.i) AS g, string_agg(line, chr(10) ORDER BY r.i) FILTER (WHERE g.i IS NULL) AS kept
    FROM line_rows r LEFT JOIN line_gone g ON r.doc_id = g.doc_id AND r.i = g.i GROUP BY r.doc_id) k ON t.doc_id = k.doc_id GROUP BY t.doc_id, t.text)"""


ORACLE = f"WITH docs AS (SELECT doc_id, text FROM documents), {lines_sql('docs')} SELECT doc_id, n_lines, n_removed, text FROM lines_kept"
