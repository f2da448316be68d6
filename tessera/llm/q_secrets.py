"""op10: secrets in all documents, each distinct text scanned once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import secret_scan as S

NAME = "op10_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, _ = S.scan(docs)
    return found.select("doc_id", *S.digest())


def _rule_sql(kind: int) -> str:
    _, pattern, group, least = S.RULES[kind]
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {kind} AS kind, start, start + l AS fin FROM (
      SELECT doc_id, k, t, l, g + coalesce(sum(g + l) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
        SELECT doc_id, k, length(parts[k]) AS g, length(hits[k]) AS l, length(tested[k]) AS t FROM (
          SELECT doc_id, parts, hits, tested, unnest(range(1, len(hits) + 1)) AS k FROM (
            SELECT doc_id, regexp_split_to_array(body, {p}) AS parts, regexp_extract_all(body, {p}, 0) AS hits, regexp_extract_all(body, {p}, {group}) AS tested FROM body)))) WHERE t >= {least}"""


_NAMES = "[" + ", ".join(f"'{r[0]}'" for r in S.RULES) + "]"
_JOINED = f"coalesce(string_agg({_NAMES}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(fin AS BIGINT), ',' ORDER BY start, kind){{}}, '')"
ORACLE = f"""WITH body AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
spans AS ({" UNION ALL ".join(_rule_sql(k) for k in range(len(S.RULES)))})
SELECT b.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256({_JOINED.format(" FILTER (WHERE kind < 3)")}) AS base_sha256, {_JOINED.format("")} AS spans
FROM body b LEFT JOIN spans s ON b.doc_id = s.doc_id GROUP BY b.doc_id"""
