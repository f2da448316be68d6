"""op13: the prefix trie of all conversations, after each has been given the first turns of its group's first one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.prefix_trie import sequences, trie

NAME = "op13_conversation_prefix_trie"
GROUP, HEADS = 20, 4


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Every conversation c with its first crc32(c) % 4 turns taken from conversation c - c % 20 (those it has)."""
    heads = seqs.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("lead"), F.slice("labels", 1, HEADS - 1).alias("hl"), F.slice("words", 1, HEADS - 1).alias("hw"))
    h = (F.crc32(F.col("conv").cast("string")) % HEADS).cast("int")
    joined = seqs.withColumn("lead", F.col("conv") - F.col("conv") % GROUP).join(heads, "lead", "left")

    def spliced(head, own, kind):
        return F.concat(F.slice(F.coalesce(F.col(head), F.array().cast(f"array<{kind}>")), F.lit(1), h), F.slice(F.col(own), h + 1, F.size(own)))

    return joined.select("conv", spliced("hl", "labels", "string").alias("labels"), spliced("hw", "words", "int").alias("words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: The reflected polynomial of CRC-32, a fixed value, fed bit by bit.
_CRC = "xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: list_transform(range(0, 8), lambda k: (ord(x) >> k) & 1))), lambda a, b: xor(a >> 1, ((xor(a, b)) & 1) * 3988292384)), 4294967295)"
ORACLE = f"""WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sized AS (SELECT c, s, CAST({_CRC.format(c="c")} % {HEADS} AS INTEGER) AS h FROM own),
whole AS (SELECT x.c, list_concat(coalesce(list_slice(y.s, 1, x.h), []), list_slice(x.s, x.h + 1, len(x.s))) AS s FROM sized x LEFT JOIN own y ON y.c = x.c - x.c % {GROUP}),
member AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM whole),
node AS (SELECT md5(CAST(list_slice(s, 1, d) AS VARCHAR)) AS k, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(s) = d), '') AS ends,
    any_value(CASE WHEN d > 0 THEN md5(CAST(list_slice(s, 1, d - 1) AS VARCHAR)) END) AS up,
    any_value(CASE WHEN d > 0 THEN len(list_filter(regexp_split_to_array(s[d].t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) ELSE 0 END) AS words
  FROM member GROUP BY ALL),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.k, node.d, node.conv_id, node.n, node.ends, node.up, node.words, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.k = node.k AND kids.d = node.d),
above AS (SELECT DISTINCT md5(CAST(list_slice(s, 1, a) AS VARCHAR)) AS k, a AS d, md5(CAST(list_slice(s, 1, d) AS VARCHAR)) AS sub, d AS sub_d FROM (SELECT s, d, unnest(range(0, d + 1)) AS a FROM member)),
roll AS (SELECT above.k, above.d, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n - 1) * f.words) AS saved FROM above JOIN full_ f ON f.k = above.sub AND f.d = above.sub_d GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, roll.n_leaves, CAST(roll.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN roll ON roll.k = f.k AND roll.d = f.d LEFT JOIN full_ p ON p.k = f.up AND p.d = f.d - 1"""
