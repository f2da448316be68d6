"""Pairs within blocks: every one of them, however large a block is, and no task that has a whole block."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from tessera.operators import fusion
from tessera.plans.queries import QUERIES


def test_pairs_of_a_large_block_are_dealt_out(spark, monkeypatch, tmp_path):
    """Before, the pairs of one brand and name came from one task."""
    monkeypatch.setattr(fusion, "CHUNK", 20)
    rng = random.Random(1)
    rows = [(k, "Brand#11" if k < 300 else rng.choice(["Brand#12", "Brand#13", None]), rng.choice(["a b", "c d"]) if k >= 300 else "a b", 1 + k % 50) for k in range(500)]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pairs = QUERIES["jn_08_blocked_pairs"](spark, str(tmp_path))
    want = sorted((p[1], p[0], q[0]) for p, q in itertools.combinations(rows, 2) if p[1] and p[1:3] == q[1:3])
    assert sorted(map(tuple, pairs.collect())) == want
    shares = [r["n"] for r in pairs.where("p_brand = 'Brand#11'").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(shares) == 300 * 299 // 2 and max(shares) < sum(shares) / 4
    near = {(r["a"], r["b"]) for r in QUERIES["flt_02_prefilter"](spark, str(tmp_path)).collect()}
    assert near and near < {w[1:] for w in want}
