"""Exact places in the order of a few large groups, without a task that holds a group.

Rows are dealt out by ranges of (group, order), so every task has a stretch of the order and numbers its rows as they come.  Counts of
each group in each stretch, summed over the stretches before, turn these numbers into places.  Only those counts, one for each stretch
that a group reaches into, are ordered by group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written


def placed(rows: DataFrame, groups: list[str], order: list[Column], weight: str | None = None) -> DataFrame:
    """``rows`` with ``before``, the rows of the same group ahead of each (or the sum of their ``weight``), and ``total``, those of the group.

    Rows equal in all of ``order`` are ahead of each other in any order; weights are integers above 0.
    """
    keyed = rows.withColumn("_w", F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint"))
    width = len(rows.columns)
    at = [rows.columns.index(g) for g in groups]

    def number(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            weights = np.asarray(batch.column(width), dtype=np.int64)
            keys = list(zip(*(batch.column(k).to_pylist() for k in at)))
            starts = [k for k in range(len(keys)) if keys[k] != (keys[k - 1] if k else last)]
            run = np.cumsum(weights) - weights + seen
            cuts = np.array(starts, dtype=np.int64)
            if len(cuts):
                base = np.concatenate([np.zeros(cuts[0], dtype=np.int64), np.repeat(run[cuts], np.diff(np.r_[cuts, len(keys)]))])
                run = run - base
            if len(keys):
                last, seen = keys[-1], int(run[-1] + weights[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), part), pa.int32()), pa.array(run, pa.int64())], [*batch.schema.names, "_part", "_run"])

    schema = keyed.limit(0).withColumns({"_part": F.lit(0), "_run": F.lit(0).cast("bigint")}).schema
    ranges = keyed.repartitionByRange(*[F.col(g) for g in groups], *order).sortWithinPartitions(*[F.col(g) for g in groups], *order)
    local = written(ranges.mapInArrow(number, schema), "ranks")
    counts = local.groupBy("_part", *groups).agg(F.sum("_w").alias("_n"))
    own = Window.partitionBy(*groups)
    offsets = counts.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.sum("_n").over(own).alias("total"),
        F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
    )
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return local.join(offsets, same).select(*rows.columns, (F.col("_run") + F.col("_off")).alias("before"), "total")
