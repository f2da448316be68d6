"""op9: quality rules over all documents, with host verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import quality_rules as Q

NAME = "op9_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")
    return Q.judge(docs, keep=["doc_id"]).select("doc_id", *[f"quality.{c}" for c in names])


_RULES = f"""[n_words < {Q.MIN_WORDS}, 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words, 5 * n_symbols > n_words AND n_words > 0,
 2 * n_dup_lines > n_text_lines, n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)]"""

#: SQL of the measures of every row of a table ``docs(doc_id, text, source)``; doc_id must be unique.
MEASURES_SQL = f"""
base AS (SELECT doc_id, source, coalesce(text, '') AS body FROM docs),
split AS (SELECT doc_id, source, body, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
  list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM base),
windows AS (SELECT doc_id, i, ws[i + 1] || chr(10) || ws[i + 2] || chr(10) || ws[i + 3] AS w FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 2)) AS i FROM split WHERE len(ws) >= 3)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, sum(least(3, i - prev)) AS n FROM (SELECT doc_id, i, lag(i, 1, -3) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM repeats) GROUP BY doc_id),
counted AS (SELECT s.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat([''], ws), 'string_agg', '')) AS BIGINT) AS word_chars,
  CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_text_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
measured AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed, {_RULES} AS rules FROM counted),
hosts AS (SELECT source, k, count(*) AS n, count(*) FILTER (WHERE rules[k]) AS f FROM measured, range(1, {len(Q.RULES) + 1}) r(k) WHERE source IS NOT NULL GROUP BY source, k),
sums AS (SELECT k, sum(f) / sum(n) AS m, sum(CAST(f AS DOUBLE) * f / n) / sum(n) - pow(sum(f) / sum(n), 2) AS v FROM hosts GROUP BY k),
prior AS (SELECT k, m, CASE WHEN v <= 1e-12 THEN {Q.PRIOR_MAX} ELSE greatest({Q.PRIOR_MIN}, least({Q.PRIOR_MAX}, m * (1 - m) / v - 1)) END AS strength FROM sums),
bad AS (SELECT DISTINCT source FROM hosts JOIN prior USING (k) WHERE (f + m * strength) / (n + strength) > {Q.MAX_HOST_RATE}),
judged AS (SELECT m.*, b.source IS NOT NULL AS host_rejected, NOT base_failed AND b.source IS NULL AS kept FROM measured m LEFT JOIN bad b ON m.source = b.source)
"""

ORACLE = f"""WITH docs AS (SELECT doc_id, text, source FROM documents), {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rejected FROM judged"""
