"""What rows of tokens have in common, all pairs, block against block, read from where the rows are written.

A join on features makes a row for every feature that two rows share, and these rows fill the disk.  Here the tokens are written once, by
their hash; each pair of blocks is one task, which reads both blocks from that table, so nothing is shuffled.  There the runs
of tokens that are the features get numbers, what only one row holds counts for its size alone, what many hold is multiplied as columns and the
rest by meeting.  Every pair is computed, and only pairs that reach the threshold come out.  Rows go by size, and two stretches of them
whose sizes rule the threshold out are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import written

#: Features and rows of a block at most (in the mean), rows of it that are multiplied at a time, and products of the rest at a time.
ENTRIES, ROWS, PART, PRODUCTS = 3_000_000, 8192, 1024, 1 << 21
#: A feature is multiplied as a column if one row in ``SHARE`` holds it; there are ``COLUMNS`` of these at most.
SHARE, COLUMNS = 32, 2048
#: Sums of whole numbers below this are exact in single precision.
EXACT = 1 << 24

_ODD = np.random.default_rng(20_240_229).integers(1, 1 << 62, (16, 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Name: (columns, whether features count as often as they occur).
KINDS = {"jaccard": ("score double", False), "overlap": ("score double", False), "cosine": ("score double", True), "screen": ("j3 double, j5 double, c5 bigint", False)}


def _runs(tokens: np.ndarray, sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all runs of these lengths."""
    ends, row = np.cumsum(sizes), np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(tokens))
    rows, hashes = [], []
    for k in lengths:
        at = np.flatnonzero(left >= k)
        h = tokens[at] * _ODD[k, 0] if k > 1 else tokens[at]
        for i in range(1, k):
            h += tokens[at + i] * _ODD[k, i]
        rows.append(row[at])
        hashes.append(h)
    return np.concatenate(rows), np.concatenate(hashes)


class _Features:
    """The features of one list of some rows: sizes of the rows (or squared norms), and what at least two of them hold, as columns or as entries by feature."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, lengths: tuple[int, ...], counted: bool) -> None:
        row, h = _runs(tokens, sizes, lengths)
        by = np.argsort(h)
        row, h = row[by], h[by]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, dtype=bool)
        code = np.cumsum(new) - 1
        often = np.bincount(code) > 1 if len(h) else np.empty(0, dtype=bool)
        several = often[code] if len(h) else new
        size = np.bincount(row[~several], minlength=len(sizes)).astype(np.float64)
        code = (np.cumsum(often) - 1)[code[several]]
        key, c = np.unique(code * len(sizes) + row[several], return_counts=True)
        code, row = key // max(len(sizes), 1), key % max(len(sizes), 1)
        x = c.astype(np.float64) if counted else np.ones(len(c))
        self.size = size + np.bincount(row, x * x, minlength=len(sizes))
        held = np.bincount(code)
        columns = np.argsort(-held, kind="stable")[:COLUMNS]
        columns = columns[held[columns] >= max(2, len(sizes) // SHARE)]
        place = np.full(len(held), -1, dtype=np.int64)
        place[columns] = np.arange(len(columns))
        place = place[code]
        dense, thin = place >= 0, (place < 0) & (held[code] > 1 if len(held) else np.empty(0, dtype=bool))
        self.width = len(columns)
        self.dense = self._by_row(row[dense], place[dense], x[dense], len(sizes))
        self.thin = self._by_row(row[thin], code[thin], x[thin], len(sizes))

    @staticmethod
    def _by_row(row: np.ndarray, code: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        by = np.argsort(row, kind="stable")
        return np.searchsorted(row[by], np.arange(n + 1)), code[by], x[by]

    def part(self, rows: np.ndarray) -> _Part:
        return _Part(self, rows)


class _Part:
    def __init__(self, features: _Features, rows: np.ndarray) -> None:
        self.n, self.size = len(rows), features.size[rows]
        (d, dense), (t, thin) = (self._taken(lists, rows) for lists in (features.dense, features.thin))
        self.matrix = np.zeros((len(rows), features.width), dtype=np.float32)
        self.matrix[d, dense[0]] = dense[1]
        by = np.argsort(thin[0], kind="stable")
        self.f, self.row, self.x = thin[0][by], t[by], thin[1][by]

    @staticmethod
    def _taken(lists: tuple[np.ndarray, ...], rows: np.ndarray):
        starts, code, x = lists
        n = starts[rows + 1] - starts[rows]
        at = np.arange(n.sum()) + np.repeat(starts[rows] - np.cumsum(n) + n, n)
        return np.repeat(np.arange(len(rows)), n), (code[at], x[at])

    def products(self, other: _Part) -> np.ndarray:
        """What each row of this and of the other one have in common; exact."""
        exact = np.sqrt(self.size.max(initial=0)) * np.sqrt(other.size.max(initial=0)) < EXACT
        x, y = (self.matrix, other.matrix) if exact else (self.matrix.astype(np.float64), other.matrix.astype(np.float64))
        out = (x @ y.T).ravel()
        lo, hi = np.searchsorted(other.f, self.f, "left"), np.searchsorted(other.f, self.f, "right")
        met = np.flatnonzero(hi > lo)
        lo, n = lo[met], (hi - lo)[met]
        ends, at = np.cumsum(n), 0
        while at < len(met):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, "right")))
            own = n[at:to]
            i = np.repeat(met[at:to], own)
            j = np.arange(len(i)) + np.repeat(lo[at:to] - np.cumsum(own) + own, own)
            cell, product = self.row[i] * other.n + other.row[j], self.x[i] * other.x[j]
            if len(cell) * 8 < len(out):
                np.add.at(out, cell, product)
            else:
                out += np.bincount(cell, product, minlength=len(out))
            at = to
        return out.reshape(self.n, other.n)


def _judged(kind: str, threshold: float, dots: list[np.ndarray], p: list[np.ndarray], q: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(i, j, columns of the kind) of the pairs that reach the threshold."""
    def share(c, x, y):
        under = np.minimum(x, y) if kind == "overlap" else np.sqrt(x * y) if kind == "cosine" else x + y - c
        return np.divide(c, under, out=np.zeros(np.broadcast(c, under).shape), where=under > 0)

    if kind == "screen":
        least = sum(share(c, x[:, None], y[None, :]) for c, x, y in zip(dots, p, q)) - 2 * threshold + 1e-9
    else:
        # a bound that costs few passes over all cells; what is near it is told exactly
        c, x, y = dots[0], p[0], q[0]
        step = threshold / (1 + threshold)
        least = c - (np.minimum.outer(threshold * x, threshold * y) if kind == "overlap" else np.multiply.outer(threshold * np.sqrt(x), np.sqrt(y)) if kind == "cosine" else np.add.outer(step * x, step * y))
        least += 1e-9 * (1 + (np.sqrt(x.max(initial=0) * y.max(initial=0)) if kind == "cosine" else 0))
    i, j = np.nonzero(least >= 0)
    shares = [share(c[i, j].astype(np.float64), x[i], y[j]) for c, x, y in zip(dots, p, q)]
    if kind == "screen":
        kept = shares[0] + shares[1] >= 2 * threshold
        i, j = i[kept], j[kept]
        return i, j, shares[0][kept], shares[1][kept], dots[1][i, j].astype(np.int64)
    kept = np.round(shares[0], 12) >= threshold if kind == "cosine" else shares[0] >= threshold
    return i[kept], j[kept], shares[0][kept]


def _may_reach(kind: str, threshold: float, p: list[np.ndarray], q: list[np.ndarray]) -> bool:
    """Whether the sizes of two stretches of rows allow the threshold."""
    if kind not in ("jaccard", "screen"):
        return True
    bounds = [min(1.0, x.max() / max(y.min(), 1), y.max() / max(x.min(), 1)) for x, y in zip(p, q)]
    return sum(bounds) >= len(bounds) * threshold - 1e-9


def stretches(block: list[tuple[str, int, int]], columns: list[str]) -> Iterator[pa.Table]:
    """The rows of a block, stretch by stretch; any file system that Arrow knows by its URI."""
    for path, start, n in block:
        files, at = FileSystem.from_uri(path)
        yield pq.read_table(at, filesystem=files, columns=columns, partitioning=None).slice(start, n).combine_chunks()


def _read(block: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, numbers of tokens and tokens of the rows of a block: stretches of files."""
    ids, sizes, tokens = [], [], []
    for rows in stretches(block, ["id", "t"]):
        lists = rows.column("t").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ids.append(rows.column("id").to_numpy())
        sizes.append(np.diff(np.asarray(lists.offsets)).astype(np.int64))
        tokens.append(np.asarray(lists.flatten(), dtype=np.int64).view(np.uint64))
    return np.concatenate(ids), np.concatenate(sizes), np.concatenate(tokens)


def _meeting(blocks: list, pairs: list[tuple[int, int]], lengths: list[tuple[int, ...]], kind: str, threshold: float, least: int):
    columns, counted = KINDS[kind]
    names = ["a", "b", *(c.split()[0] for c in columns.split(", "))]

    def one(p: int, q: int):
        halves = [_read(blocks[k]) for k in ((p,) if p == q else (p, q))]
        ids, sizes, tokens = (np.concatenate(c) for c in zip(*halves))
        lists = [_Features(tokens, sizes, k, counted) for k in lengths]
        del tokens
        stretches = []
        for start, end in ((0, len(halves[0][0])), (len(ids) - len(halves[-1][0]), len(ids))):
            rows = np.arange(start, end)
            rows = rows[lists[0].size[rows] >= max(least, 1)]
            rows = rows[np.argsort(lists[0].size[rows], kind="stable")]
            stretches.append([rows[at : at + PART] for at in range(0, len(rows), PART)])
        of = lambda rows: [f.part(rows) for f in lists]
        right = [of(rows) for rows in stretches[1]]
        for m, own in enumerate(stretches[0]):
            left = right[m] if p == q else of(own)
            for k in range(m if p == q else 0, len(right)):
                x, y = [v.size for v in left], [v.size for v in right[k]]
                if not _may_reach(kind, threshold, x, y):
                    continue
                i, j, *values = _judged(kind, threshold, [u.products(v) for u, v in zip(left, right[k])], x, y)
                if p == q and m == k:
                    once = i < j
                    i, j, values = i[once], j[once], [v[once] for v in values]
                if len(i):
                    a, b = ids[own[i]], ids[stretches[1][k][j]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(a, b), np.maximum(a, b), *values)], names=names)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from one(*pairs[k])

    return run, f"a bigint, b bigint, {columns}"


def dealt(sizes: list, entries: int, rows: int) -> list[list[tuple[str, int, int]]]:
    """Stretches of files (path, rows, features) dealt into blocks of so many features and rows at most, in the mean of a file."""
    out, n, e = [], 0, 0
    for path, held, has in sizes:
        parts = max(1, -(-has // entries), -(-held // rows))
        for k in range(parts):
            start, end = held * k // parts, held * (k + 1) // parts
            if not out or n + end - start > rows or e + has // parts > entries:
                out.append([])
                n = e = 0
            out[-1].append((path, start, end - start))
            n, e = n + end - start, e + has // parts
    return out


def hashed_tokens(catalog: DataFrame, array: str) -> DataFrame:
    """(id, t): each row's list ``array`` by 64-bit hash, in its order, written; rows without one are left out."""
    return written(catalog.selectExpr("cast(id AS bigint) AS id", f"transform({array}, f -> xxhash64(f)) AS t").where("size(t) > 0"), "tokens")


def common_pairs(tokens: DataFrame, kind: str, threshold: float, lengths: list[tuple[int, ...]] | None = None, least: int = 1) -> DataFrame:
    """(a, b, ...), a < b: all pairs of ``hashed_tokens`` that reach the threshold, by one of ``KINDS``.

    ``lengths`` are those of the runs of tokens that are features: one list, or two for ``screen``.  Rows of fewer than ``least``
    features are left out.
    """
    spark = tokens.sparkSession
    lengths = lengths or [(1,)]
    per = sum(len(k) for k in lengths)
    sizes = tokens.groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("t")).alias("e")).orderBy("path").collect()
    n, cores = sum(r["n"] for r in sizes), spark.sparkContext.defaultParallelism
    rows = min(ROWS, max(256, -(-n // max(1, int(np.ceil(np.sqrt(6 * cores)))))))
    blocks = dealt([(r["path"], r["n"], r["e"] * per) for r in sizes], ENTRIES, rows)
    pairs = [(p, q) for p in range(len(blocks)) for q in range(p, len(blocks))]
    run, schema = _meeting(blocks, pairs, lengths, kind, threshold, least)
    return spark.range(0, len(pairs), 1, max(1, len(pairs))).mapInArrow(run, schema)
