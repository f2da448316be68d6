"""Catalogs of several sources, and pairs within blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import REGISTRY, DuckDialect

plan = REGISTRY.plan


@plan("sim_13_catalog_union")
def catalog_union(d):
    """One row per key; the first source wins, blanks are filled from later ones."""
    return f"""WITH u AS (SELECT s_nationkey AS k, 1 AS rank, nullif(s_name, '') AS name, s_acctbal AS bal, s_suppkey AS o FROM {d.table('supplier')} s UNION ALL SELECT c_nationkey, 2, nullif(c_mktsegment, ''), c_acctbal, c_custkey FROM {d.table('customer')} c),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, o) AS q FROM u)
SELECT k, max(CASE WHEN q = 1 THEN name END) AS name, max(CASE WHEN q = 1 THEN bal END) AS bal, count(*) AS n_rows FROM r GROUP BY k"""


#: Rows of a block that are in one list, in the mean; a list meets one other at a time.
CHUNK = 512


def within_blocks(rows: DataFrame, block: list[str], value: str) -> DataFrame:
    """(block, x, y) of all rows of one block, x.id < y.id; x and y are structs ``value`` with an id.

    However many rows a block has, they are cut into lists of bounded size, and meetings of two lists, which are few and all alike, are dealt out to
    tasks: so a table of few files or few blocks keeps all cores busy, and no pair is sent.
    """
    spark = rows.sparkSession
    held = rows.selectExpr(*block, f"{value} AS v").where("v.id IS NOT NULL")
    sizes = held.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    dealt = held.join(sizes, block).withColumn("k", F.expr(f"pmod(xxhash64(v.id), (n - 1) div {CHUNK} + 1)"))
    lists = dealt.groupBy(*block, "k").agg(F.collect_list("v").alias("vs"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    p, q = lists.select(*block, F.col("k").alias("p"), F.col("vs").alias("xs")), lists.select(*block, F.col("k").alias("q"), F.col("vs").alias("ys"))
    met = p.join(q, block).repartition(tasks, *block, "p", "q")
    return met.select(*block, "ys", F.explode("xs").alias("x")).select(*block, "x", F.explode("ys").alias("y")).where("x.id < y.id")


def blocked(d):
    return f"SELECT x.p_brand, x.p_partkey AS a, y.p_partkey AS b FROM {d.table('part')} x JOIN {d.table('part')} y ON x.p_brand = y.p_brand AND x.p_name = y.p_name AND x.p_partkey < y.p_partkey"


@REGISTRY.frame("jn_08_blocked_pairs", blocked(DuckDialect()))
def _blocked(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder}/part.parquet")
    return within_blocks(parts, ["p_brand", "p_name"], "named_struct('id', p_partkey)").selectExpr("p_brand", "x.id AS a", "y.id AS b")


@plan("jn_03_hash_buckets")
def buckets(d):
    return f"SELECT {d.sha('text')} AS h, count(*) AS n, min(doc_id) AS first_id FROM {d.table('documents')} x WHERE text IS NOT NULL GROUP BY {d.sha('text')} HAVING count(*) > 1"
