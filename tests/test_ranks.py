"""Places against sorting in memory, and plans without a window over the groups' rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.ranks import placed


def table(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(20)])) for k in range(500)] + [(500, "c", 1)]


@pytest.mark.parametrize(("seed", "parts"), [(1, "1"), (2, "7"), (3, "40")])
def test_places_equal_sorting(spark, seed, parts):
    rows = table(seed)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["id"]: (r["before"], r["total"]) for r in placed(spark.createDataFrame(rows, "id bigint, g string, v int"), ["g"], [F.col("v").desc_nulls_last(), F.col("id")]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    want = {}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want |= {r[0]: (k, len(own)) for k, r in enumerate(own)}
    assert got == want


def test_weights(spark):
    rows = [("a", 5, 2), ("a", 7, 3), ("a", 1, 1), ("b", 1, 4)]
    got = {(r["g"], r["v"]): (r["before"], r["total"]) for r in placed(spark.createDataFrame(rows, "g string, v int, n bigint"), ["g"], [F.col("v")], weight="n").collect()}
    assert got == {("a", 1): (0, 6), ("a", 5): (1, 6), ("a", 7): (3, 6), ("b", 1): (0, 4)}


def test_several_groups_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "x", 3), (1, "y", 2), (1, "x", 1)], "p int, q string, v int")
    assert {(r["p"], r["q"], r["v"]): r["before"] for r in placed(rows, ["p", "q"], [F.col("v")]).collect()} == {(1, "x", 1): 0, (1, "x", 3): 1, (1, "y", 2): 0}
    assert placed(rows.where("v > 9"), ["p"], [F.col("v")]).collect() == []


def test_windows_hold_counts_alone(spark):
    """What a window orders is one row for each stretch, not the rows of a group."""
    df = placed(spark.range(20_000).selectExpr("id % 3 AS g", "id AS v"), ["g"], [F.col("v")])
    assert df.count() == 20_000
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "Aggregate [_part" in window
