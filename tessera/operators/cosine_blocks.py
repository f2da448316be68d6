"""Cosines of all pairs of rows, block against block.

Most texts of a language share its frequent words, so a join on words makes a row for nearly every pair and every word.  Here a row
is one vector: the counts of the features that many rows hold, and a list of the others that at least two hold.  Vectors are dealt
into blocks of bounded size, each pair of blocks meets in one task, and only pairs that reach the threshold come out.  A task reads its
blocks from the table that holds the vectors, so none is sent; every pair is computed, and none is kept that is below the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.token_blocks import ENTRIES, dealt, stretches
from tessera.sources.scratch import written

#: Vectors a block at most (in the mean), rows of a block that are multiplied at a time, and products of the other features at a time.
BLOCK, PART, PRODUCTS = 24_000, 1024, 1 << 22
#: A feature is multiplied as a column if one row in ``SHARE`` holds it; there are ``COLUMNS`` of these at most.
SHARE, COLUMNS = 32, 2048
#: More than single precision loses over ``COLUMNS`` products of unit vectors.
SLACK = 2e-4


def _ints(column: pa.Array, kind) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=kind)


def bags(catalog: DataFrame, array: str) -> DataFrame:
    """(id, copies, f, c): each row's distinct features by 64-bit hash with their counts, written."""

    def count(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            f, row = _ints(lists, np.int64), np.repeat(np.arange(len(sizes)), sizes)
            by = np.lexsort((f, row))
            f, row = f[by], row[by]
            first = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (row[1:] != row[:-1])]) if len(f) else np.empty(0, dtype=np.int64)
            counts = np.diff(np.r_[first, len(f)]).astype(np.int32)
            offsets = pa.array(np.searchsorted(row[first], np.arange(len(sizes) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(f[first])), pa.ListArray.from_arrays(offsets, pa.array(counts))], names=["id", "copies", "f", "c"])

    copies = "copies" if "copies" in catalog.columns else "1"
    hashed = catalog.selectExpr("cast(id AS bigint) AS id", f"cast({copies} AS bigint) AS copies", f"transform({array}, f -> xxhash64(f)) AS f").where("size(f) > 0")
    return written(hashed.mapInArrow(count, "id bigint, copies bigint, f array<bigint>, c array<int>"), "bags")


def _split(keys: np.ndarray):
    """Rows with their features among ``keys`` (sorted) by number, and the others."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            f, c, row = _ints(lists, np.int64), _ints(batch.column(3), np.int32), np.repeat(np.arange(len(sizes)), sizes)
            place = np.minimum(np.searchsorted(keys, f), max(len(keys) - 1, 0))
            among = keys[place] == f if len(keys) else np.zeros(len(f), dtype=bool)
            out = [batch.column(0), batch.column(1)]
            for own, values in ((among, place.astype(np.int32)), (among, c), (~among, f), (~among, c)):
                offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row[own], minlength=len(sizes)))].astype(np.int32))
                out.append(pa.ListArray.from_arrays(offsets, pa.array(values[own])))
            yield pa.RecordBatch.from_arrays(out, names=["id", "copies", "k", "kc", "f", "c"])

    return run


class _Part:
    """Some rows of a block: ids, squared norms, a matrix of their frequent features, and their other ones ordered by feature."""

    def __init__(self, rows: pa.Table, idf: np.ndarray) -> None:
        rows = rows.combine_chunks()
        column = lambda name: rows.column(name).chunk(0)
        self.id, self.square = (np.asarray(column(c)) for c in ("id", "square"))
        owner = lambda lists: np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(lists.offsets)))
        k, rest = column("k"), column("rest")
        self.matrix = np.zeros((rows.num_rows, len(idf)))
        places = _ints(k, np.int64)
        self.matrix[owner(k), places] = _ints(column("kc"), np.float64) * idf[places]
        self.unit = (self.matrix / np.sqrt(self.square)[:, None]).astype(np.float32)
        entries = rest.flatten()
        f, row = np.asarray(entries.field(0), dtype=np.int64), owner(rest)
        by = np.argsort(f, kind="stable")
        self.f, self.row = f[by], row[by]
        self.idf = np.asarray(entries.field(2))[by]
        self.x = np.asarray(entries.field(1))[by] * self.idf

    def products(self, other: _Part, weigh) -> np.ndarray:
        """Sums over the other features that two rows share of ``weigh(self, i, other, j)``, some at a time."""
        lo, hi = np.searchsorted(other.f, self.f, "left"), np.searchsorted(other.f, self.f, "right")
        ends = np.cumsum(hi - lo)
        out = np.zeros(len(self.id) * len(other.id))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, "right")))
            n = hi[at:to] - lo[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.arange(len(i)) + np.repeat(lo[at:to] - np.cumsum(n) + n, n)
            if len(i):
                cell = self.row[i] * len(other.id) + other.row[j]
                if len(cell) * 8 < len(out):
                    np.add.at(out, cell, weigh(self, i, other, j))
                else:
                    out += np.bincount(cell, weigh(self, i, other, j), minlength=len(out))
            at = to
        return out.reshape(len(self.id), len(other.id))


def _reached(x: _Part, y: _Part, same: bool, threshold: float, least: float, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, score) of the pairs of two parts that reach the threshold and share features of ``least`` idf in all."""
    more = x.products(y, lambda p, i, q, j: p.x[i] * q.x[j])
    near = x.unit @ y.unit.T + more / np.sqrt(x.square)[:, None] / np.sqrt(y.square)[None, :]
    i, j = np.nonzero(near >= threshold - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    dot = more[i, j]
    shared = None
    if least > 0 and len(i):
        shared = x.products(y, lambda p, i, q, j: p.idf[i])[i, j]
    for at in range(0, len(i), PART):
        own = slice(at, at + PART)
        p, q = x.matrix[i[own]], y.matrix[j[own]]
        dot[own] += np.einsum("ij,ij->i", p, q)
        if shared is not None:
            shared[own] += ((p != 0) & (q != 0)) @ idf
    score = dot / np.sqrt(x.square[i] * y.square[j])
    kept = np.round(score, 12) >= threshold
    if shared is not None:
        kept &= np.round(shared, 12) >= least
    a, b = x.id[i[kept]], y.id[j[kept]]
    return np.minimum(a, b), np.maximum(a, b), score[kept]


def _meeting(blocks: list, pairs: list[tuple[int, int]], idf: np.ndarray, threshold: float, least: float):
    def one(p: int, q: int):
        halves = [pa.concat_tables(stretches(blocks[k], ["id", "k", "kc", "square", "rest"])) for k in ((p,) if p == q else (p, q))]
        cut = [[h.slice(at, PART) for at in range(0, h.num_rows, PART)] for h in halves]
        for m, left in enumerate(cut[0]):
            x = _Part(left, idf)
            for k, right in enumerate(cut[-1]):
                if p == q and k < m:
                    continue
                y = x if p == q and k == m else _Part(right, idf)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _reached(x, y, x is y, threshold, least, idf)], names=["a", "b", "score"])

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from one(*pairs[k])

    return run


def cosine_pairs(catalog: DataFrame, array: str, threshold: float, total: float | None = None, least: float = 0.0) -> DataFrame:
    """(a, b, score): all pairs whose counts of the features in ``array`` have a cosine that reaches the threshold.

    With ``total``, counts are weighed by ln(total / df), where a row that stands for several (column ``copies``) counts as often in df,
    and pairs must share features of ``least`` of these in all.
    """
    spark = catalog.sparkSession
    rows = bags(catalog, array)
    n = rows.count()
    each = rows.select("copies", F.explode("f").alias("f"))
    often = written(each.groupBy("f").agg(F.sum("copies").alias("df"), F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
    columns = often.where(F.col("held") >= max(2, n // SHARE)).orderBy(F.desc("held"), "f").limit(COLUMNS).orderBy("f").toArrow()
    keys = np.asarray(columns.column("f"), dtype=np.int64)
    idf = np.log(total / np.asarray(columns.column("df"), dtype=np.float64)) if total else np.ones(len(keys))
    split = written(rows.mapInArrow(_split(keys), "id bigint, copies bigint, k array<int>, kc array<int>, f array<bigint>, c array<int>"), "split")
    # what only one row holds has its copies as df, adds to its norm and is dropped
    log = f"ln({float(total)!r}D / coalesce(df, copies))" if total else "1D"
    entries = split.select("id", "copies", F.explode(F.arrays_zip("f", "c")).alias("e")).select("id", "copies", "e.f", "e.c").join(often, "f", "left").selectExpr("id", "f", "cast(c AS double) AS c", f"{log} AS w", "held")
    others = entries.groupBy("id").agg(F.expr("sum(c * w * c * w) AS square"), F.expr("collect_list(CASE WHEN held > 1 AND w > 0 THEN struct(f, c, w) END) AS rest"))

    def squares(k: pa.Array, kc: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(k)), np.diff(np.asarray(k.offsets)))
        return pa.array(np.bincount(row, (_ints(kc, np.float64) * idf[_ints(k, np.int64)]) ** 2, minlength=len(k)))

    whole = split.select("id", "k", "kc", F.arrow_udf(squares, "double")("k", "kc").alias("_s")).join(others, "id", "left")
    vectors = whole.selectExpr("id", "k", "kc", "_s + coalesce(square, 0D) AS square", "coalesce(rest, cast(array() AS array<struct<f:bigint,c:double,w:double>>)) AS rest").where("square > 0")
    vectors = written(vectors, "vectors")
    sizes = vectors.groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("k") + F.size("rest")).alias("e")).orderBy("path").collect()
    block = min(BLOCK, max(256, -(-n // int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism))))))
    blocks = dealt([(r["path"], r["n"], r["e"]) for r in sizes], ENTRIES, block)
    pairs = [(p, q) for p in range(len(blocks)) for q in range(p, len(blocks))]
    return spark.range(0, len(pairs), 1, max(1, len(pairs))).mapInArrow(_meeting(blocks, pairs, idf, threshold, least), "a bigint, b bigint, score double")
