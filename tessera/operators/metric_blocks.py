"""Rows whose metrics lie near each other, block against block.

Rows are dealt into blocks of bounded size and each pair of blocks meets in one task.  There a block is cut into tiles of rows that know the
same metrics and lie close together; two tiles are compared only if the least gaps that their ranges allow still fit, and pairs come out
as they are found.  Every pair that reaches the bound is found, and what is sent is each row once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a block at most (in the mean), and pairs that come out at a time.
BLOCK, OUT = 16_000, 1 << 16


def _tiles(values: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of rows by tile: rows with the same unknown metrics, halved at the metric whose logarithms spread most until they fit."""
    logs, (_, kind) = np.log(np.maximum(np.nan_to_num(values), 1.0)), np.unique(np.isnan(values), axis=0, return_inverse=True)
    todo, out = [np.flatnonzero(kind.ravel() == k) for k in range(int(kind.max(initial=-1)) + 1)], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = logs[rows]
        rows = rows[np.argsort(own[:, np.argmax(np.ptp(own, axis=0))], kind="stable")]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


class _Block:
    """Rows of one block, tile by tile, and the range of each metric in each tile (NaN where it is unknown)."""

    def __init__(self, rows: pa.Table, metrics: tuple[str, ...], size: int) -> None:
        values = np.column_stack([rows.column(c).to_numpy() for c in metrics]).astype(np.float64)
        tiles = _tiles(values, size)
        ids, copies = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        self.values, self.id, self.n = ([c[t] for t in tiles] for c in (values, ids, copies))
        self.low, self.high = (np.array([f(v, axis=0) for v in self.values]).reshape(len(tiles), len(metrics)) for f in (np.min, np.max))


def _near(block: _Block, other: _Block, k: int, gap: float, least: int) -> np.ndarray:
    """Tiles of ``other`` that may have rows whose mean gap to those of the block's tile k is ``gap`` at most, over ``least`` metrics."""
    apart = np.maximum(np.maximum(other.low - block.high[k], block.low[k] - other.high), 0.0)
    gaps = apart / np.maximum(np.maximum(other.low, block.low[k]), 1.0)
    shared = np.count_nonzero(~np.isnan(gaps), axis=1)
    return np.flatnonzero((shared >= least) & (np.nansum(gaps, axis=1) <= gap * shared + 1e-9))


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - mean of |p - q| / max(p, q, 1) over the metrics that both tiles know, summed in their order."""
    total, known = np.zeros((len(x), len(y))), np.flatnonzero(~np.isnan(x[0]) & ~np.isnan(y[0]))
    for k in known:
        p, q = x[:, k, None], y[None, :, k]
        gaps = p - q
        np.abs(gaps, out=gaps)
        gaps /= np.maximum(np.maximum(p, 1.0), q)
        total += gaps
    return 1 - total / len(known)


def _meeting(metrics: tuple[str, ...], gap: float, least: int, size: int):
    def run(key, batches):
        p, q = key[0].as_py(), key[1].as_py()
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        side = rows.column("block").to_numpy()
        x, y = (_Block(rows.filter(pa.array(side == k)), metrics, size) for k in (p, q))
        held, n = [], 0
        for k in range(len(x.id)):
            for m in _near(x, y, k, gap, least):
                if p == q and m < k:
                    continue
                scores = _scores(x.values[k], y.values[m])
                i, j = np.nonzero(scores >= 1 - gap - 1e-9)
                if p == q and m == k:
                    i, j = i[i < j], j[i < j]
                a, b = x.id[k][i], y.id[m][j]
                turned = a > b
                copies = x.n[k][i], y.n[m][j]
                held.append((np.where(turned, b, a), np.where(turned, a, b), np.where(turned, *copies[::-1]), np.where(turned, *copies), scores[i, j]))
                n += len(i)
                if n >= OUT:
                    yield _batch(held)
                    held, n = [], 0
        if held:
            yield _batch(held)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _batch(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["a", "b", "n_a", "n_b", "score"])


def near_rows(rows: DataFrame, metrics: tuple[str, ...], gap: float, least: int, size: int) -> DataFrame:
    """(a, b, n_a, n_b, score), a < b: all pairs of ``rows`` (id, n and metrics) whose mean relative difference over at least ``least`` metrics
    that both know is ``gap`` or less; score is what it leaves of 1.  Rows are compared in tiles of ``size``."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK), min(-(-n // 512), int(np.ceil(np.sqrt(8 * cores)))))
    dealt = rows.selectExpr("cast(id AS bigint) AS id", "cast(n AS bigint) AS n", *metrics, f"cast(pmod(xxhash64(id), {blocks}) AS int) AS block")
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).selectExpr("least(block, o) AS p", "greatest(block, o) AS q", "*").drop("o")
    return met.repartition(blocks * (blocks + 1) // 2, "p", "q").groupBy("p", "q").applyInArrow(_meeting(metrics, gap, least, size), "a bigint, b bigint, n_a bigint, n_b bigint, score double")
