"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as joins.

Neighbours are never gathered into lists: a vertex's least neighbour comes from an aggregation with partial sums and
is joined back, so a vertex with very many neighbours is a key that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.where("u <> v")
    return out if large else out.distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that keep edges (u, v) from being stars: those with several centres, or with one and leaves of their own."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the component is its smallest node.

    Steps end as soon as the edges are stars; edges that are to begin with take none.  Duplicate edges, loops and either
    orientation are fine; an empty table gives an empty result.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(now, "cc")
    while not _unsettled(now).isEmpty():
        now = materialise(_star(_star(now, True), False), "cc")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
