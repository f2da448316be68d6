"""Hard negatives by a pivot table: exact inner-product bands, most rows excluded by stored distances.

A row's vector gets one more component, sqrt(M - |v|^2) with M the greatest squared norm, and an anchor's gets 0: a greater inner
product is then a smaller Euclidean distance.  Every row stores its distances to a few pivots.  By the triangle
inequality |d(anchor, p) - d(row, p)| and d(anchor, p) + d(row, p) bracket the distance, and so the score: first for whole tiles
of rows that lie near each other, then for single rows.  Rows whose bracket meets the band asked for are checked exactly.

Anchors are a stated query set.  They are taken in blocks of bounded bytes, each sent to all tasks; the tiles are read once a block
and search.  A task keeps the best rows of each anchor, and starts from the bounds that a bounded sample of rows proves.
Pivots and bounds come from that sample (``SAMPLE`` rows of least hash, fewer for very long vectors); neither changes a result, and
every row is in the table.

Edges: a row without id, label or vector, or with a null or non-finite component, takes no part, nor does one with a component that
reaches 2^26 (its scores could exceed a long); only vectors of one length are compared, and an empty one scores 0; rows
with one id are rows each, but never their own anchor's positive or negative, and an anchor's id is taken once (its least
label and vector); equal scores go by id; empty tables and tables without anchors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

PIVOTS, TILE = 8, 2048
#: Anchors that are held against one tile, or the sample, at a time.
CHUNK = 256
#: Rows of the sample, and the components that it may have in all.
SAMPLE, SAMPLE_VALUES = 4096, 1 << 21
#: Bytes of the anchors that are sent to all tasks at one time.
BLOCK_BYTES = 16 << 20
#: Beyond this size of a component scores could exceed a long.
GREATEST = 1 << 26

_LOW = np.iinfo(np.int64).min
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


class Rows:
    """Rows of one vector length: ids, labels, integer vectors, and their squared norms."""

    def __init__(self, ids, labels, vectors: np.ndarray):
        self.ids, self.labels = np.asarray(ids, dtype=np.int64), np.asarray(labels, dtype=np.int64)
        self.vectors = np.ascontiguousarray(vectors, dtype=np.int32)
        wide = self.vectors.astype(np.float64)
        self.norms = np.einsum("ij,ij->i", wide, wide)

    def __len__(self) -> int:
        return len(self.ids)


def scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """All inner products as exact integers; ``bound`` is the product of the greatest norms, which no partial sum exceeds."""
    if bound < 2.0**23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of augmented vectors (x, lift) to augmented pivots."""
    wide, points = x.astype(np.float64), pivots[:, :-1]
    apart = (wide**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * wide @ points.T + (lift[:, None] - pivots[None, :, -1]) ** 2
    return np.sqrt(np.maximum(apart, 0.0))


def choose_pivots(rows: Rows, most: float) -> np.ndarray:
    """Rows of the sample that lie far apart, farthest first, as augmented vectors."""
    whole = np.column_stack([rows.vectors.astype(np.float64), np.sqrt(np.maximum(most - rows.norms, 0.0))])
    at = [int(np.argmin(rows.ids))] if len(rows) else []
    least = np.full(len(rows), np.inf)
    while at and len(at) < min(PIVOTS, len(rows)):
        least = np.minimum(least, distances(rows.vectors, whole[:, -1], whole[at[-1:]])[:, 0])
        if least.max() <= 0:
            break
        at.append(int(least.argmax()))
    return whole[at]


class Best:
    """The best ``k`` rows of each slot, higher scores first, ties by smaller id; and the score that a row must reach."""

    def __init__(self, slots: int, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.slot, self.score, self.id = (np.empty(0, dtype=np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        keep = score >= self.least[slot]
        if not keep.any():
            return
        slot, score, id = np.r_[self.slot, slot[keep]], np.r_[self.score, score[keep]], np.r_[self.id, id[keep]]
        order = np.lexsort((id, -score, slot))
        slot, score, id = slot[order], score[order], id[order]
        first = np.r_[True, slot[1:] != slot[:-1]]
        rank = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], id[keep]
        full = rank[keep] == self.k - 1
        self.least[self.slot[full]] = np.maximum(self.least[self.slot[full]], self.score[full])


def _chunks(n: int) -> Iterator[np.ndarray]:
    for k in range(0, n, CHUNK):
        yield np.arange(k, min(n, k + CHUNK))


class Anchors:
    """A block of anchors of one vector length, what the sample proves about them, and the search over tiles."""

    def __init__(self, rows: Rows, sample: Rows | None, pivots: np.ndarray, most: float):
        self.rows, self.sample, self.most = rows, sample, most
        self.distances = distances(rows.vectors, np.zeros(len(rows)), pivots) if len(pivots) else np.zeros((len(rows), 0))
        self.greatest = float(np.sqrt(max(most, 0.0)))

    def _bound(self) -> float:
        return self.greatest * float(np.sqrt(self.rows.norms.max(initial=0.0)))

    def _sampled(self, at: np.ndarray) -> np.ndarray:
        return scores(self.rows.vectors[at], self.sample.vectors, self._bound())

    def positives_of(self, k: int) -> Best:
        """Starts the search for the best ``k`` other rows of the same label."""
        least = np.full(len(self.rows), _LOW)
        if self.sample is not None and len(self.sample) >= k:
            for at in _chunks(len(self.rows)):
                same = (self.rows.labels[at, None] == self.sample.labels[None, :]) & (self.rows.ids[at, None] != self.sample.ids[None, :])
                least[at] = np.partition(np.where(same, self._sampled(at), _LOW), -k, axis=1)[:, -k]
        return Best(len(self.rows), k, least)

    def negatives_of(self, k: int, slots: np.ndarray, low: np.ndarray, high: np.ndarray) -> Best:
        """Starts the search for the best ``k`` rows of other labels in [low, high] of each slot (an anchor's positive)."""
        least = low.copy()
        if self.sample is not None and len(self.sample) >= k:
            for at in _chunks(len(slots)):
                found = self._sampled(slots[at])
                fits = (self.rows.labels[slots[at], None] != self.sample.labels[None, :]) & (found >= low[at, None]) & (found <= high[at, None])
                least[at] = np.maximum(least[at], np.partition(np.where(fits, found, _LOW), -k, axis=1)[:, -k])
        return Best(len(slots), k, least)

    def survivors(self, tile: Rows, stored: np.ndarray, need: np.ndarray, above: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose bracket meets [need, above] of the anchor, and whose labels are equal or not."""
        low, high = stored.min(0)[None, None], stored.max(0)[None, None]
        at = np.flatnonzero(self._meets(self.distances[:, None], low, high, need[:, None], above[:, None], slice(None))[:, 0])
        found = [(np.empty(0, dtype=np.int64),) * 3]
        for some in _chunks(len(at)):
            one = at[some]
            hit = self._meets(self.distances[one][:, None], stored[None], stored[None], need[one][:, None], above[one][:, None], one)
            hit &= (self.rows.labels[one][:, None] == tile.labels[None, :]) == same
            a, r = np.nonzero(hit)
            if len(a) * 8 > hit.size:
                s = scores(self.rows.vectors[one], tile.vectors, self._bound())[a, r]
            else:
                s = np.einsum("ij,ij->i", self.rows.vectors[one[a]].astype(np.int64), tile.vectors[r].astype(np.int64))
            fits = (s >= need[one[a]]) & (s <= above[one[a]])
            found.append((one[a[fits]], r[fits], s[fits]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _meets(self, own: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray, above: np.ndarray, at) -> np.ndarray:
        """Whether the scores that the triangle inequality leaves open meet [need, above]; exact up to a slack on the safe side."""
        shape = np.broadcast_shapes(own.shape[:2], low.shape[:2], need.shape)
        near, far = np.zeros(shape), np.full(shape, np.inf)
        for p in range(own.shape[2]):
            x, a, b = own[:, :, p], low[:, :, p], high[:, :, p]
            near = np.maximum(near, np.maximum(x - b, a - x))
            far = np.minimum(far, x + b)
        slack = 1e-6 * (self.greatest + float(np.sqrt(self.rows.norms.max(initial=0.0))) + 1.0)
        both = (self.rows.norms[at] + self.most)[:, None]
        most = (both - np.maximum(near - slack, 0.0) ** 2) / 2 + 0.5
        least = (both - (far + slack) ** 2) / 2 - 0.5
        return (most >= need) & (least <= above)


def prepared(vectors: DataFrame, id: str, label: str, vector: str, anchor: str) -> DataFrame:
    """(id, label, v, anchor, norm) of the rows that take part; ``vector`` is an array of integers as bigint."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & (x > -GREATEST) & (x < GREATEST))
    named = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("v"), F.coalesce(F.col(anchor), F.lit(False)).alias("anchor"))
    return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fine).withColumn("norm", F.aggregate(v, F.lit(0).cast("bigint"), lambda s, x: s + x * x))


def _rows(table: pa.Table | pa.RecordBatch) -> dict[int, Rows]:
    """Rows (id, label, v) by vector length."""
    out = {}
    sizes = np.array([len(v) for v in table["v"].to_pylist()], dtype=np.int64) if table.num_rows else np.empty(0, dtype=np.int64)
    flat = table["v"].combine_chunks() if isinstance(table, pa.Table) else table["v"]
    values = np.asarray(flat.flatten()) if table.num_rows else np.empty(0, dtype=np.int64)
    at = np.cumsum(sizes) - sizes
    ids, labels = np.asarray(table["id"]), np.asarray(table["label"])
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        out[size] = Rows(ids[own], labels[own], values[at[own][:, None] + np.arange(size)[None, :]])
    return out


def mine(vectors: DataFrame, id: str = "id", label: str = "label", vector: str = "vector", anchor: str = "anchor", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose score
    s has low * positive <= 100 * s <= high * positive: ``RESULT``."""
    spark = vectors.sparkSession
    items = prepared(vectors, id, label, vector, anchor)
    shapes = items.groupBy(F.size("v").alias("size")).agg(F.max("norm").alias("most"), F.sum(F.col("anchor").cast("int")).alias("anchors")).collect()
    most = {r["size"]: float(r["most"]) for r in shapes}
    wanted = max(1, min(SAMPLE, SAMPLE_VALUES // max(1, max(most, default=1))))
    some = items.select("id", "label", "v").orderBy(F.xxhash64("id"), "label", "v").limit(wanted).toArrow()
    samples = _rows(some)
    pivots = {size: choose_pivots(rows, most[size]) for size, rows in samples.items()}
    tiles = _tiles(items, most, pivots)

    total = sum((r["anchors"] or 0) * (8 * r["size"] + 32) for r in shapes)
    blocks = max(1, -(-total // BLOCK_BYTES))
    chosen = items.where("anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    chosen = materialise(chosen.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition("block"), "negatives-anchors") if total else None
    out = spark.createDataFrame([], RESULT)
    for block in range(blocks if total else 0):
        queries = {size: Anchors(rows, samples.get(size), pivots.get(size, np.zeros((0, size + 1))), most[size]) for size, rows in _rows(chosen.where(F.col("block") == block).select("id", "label", "v").toArrow()).items()}
        if queries:
            found = _search(spark, tiles, queries, positives, negatives, low, high)
            out = found if block == 0 or not out.columns else out.unionByName(found)
    return out


def _tiles(items: DataFrame, most: dict[int, float], pivots: dict[int, np.ndarray]) -> DataFrame:
    """The pivot table: tiles of rows with one length, near each other, with vectors and distances packed."""
    held = items.sparkSession.sparkContext.broadcast((most, pivots))

    def measured(batches):
        most, pivots = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, TILE):
                for size, rows in _rows(batch.slice(k, TILE)).items():
                    points = pivots.get(size, np.zeros((0, size + 1)))
                    far = distances(rows.vectors, np.sqrt(np.maximum(most[size] - rows.norms, 0.0)), points) if len(points) else np.zeros((len(rows), 0))
                    cell = far.argmin(1) if far.size else np.zeros(len(rows), dtype=np.int64)
                    near = far.min(1) if far.size else np.zeros(len(rows))
                    columns = [pa.array(np.full(len(rows), size), pa.int32()), pa.array(cell, pa.int32()), pa.array(near, pa.float64()), pa.array(rows.ids), pa.array(rows.labels)]
                    packed = [pa.array([x.tobytes() for x in rows.vectors], pa.binary()), pa.array([x.tobytes() for x in far.astype(np.float32)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns + packed, ["size", "cell", "near", "id", "label", "v", "far"])

    def packed(batches):
        for batch in batches:
            size = np.asarray(batch["size"])
            cuts = np.r_[0, np.flatnonzero(np.diff(size)) + 1, len(size)]
            cuts = np.unique(np.concatenate([np.r_[np.arange(a, b, TILE), b] for a, b in zip(cuts[:-1], cuts[1:])])) if len(size) else cuts
            rows = [(int(size[a]), np.asarray(batch["id"])[a:b].tobytes(), np.asarray(batch["label"])[a:b].tobytes(), b"".join(batch["v"].slice(a, b - a).to_pylist()), b"".join(batch["far"].slice(a, b - a).to_pylist())) for a, b in zip(cuts[:-1], cuts[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["size", "ids", "labels", "vs", "fars"])

    table = items.select("id", "label", "v").mapInArrow(measured, "size int, cell int, near double, id bigint, label bigint, v binary, far binary")
    near = table.repartitionByRange("size", "cell", "near", "id").sortWithinPartitions("size", "cell", "near", "id")
    return materialise(near.mapInArrow(packed, "size int, ids binary, labels binary, vs binary, fars binary"), "negatives-tiles")


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Rows, np.ndarray]]:
    for size, ids, labels, vs, fars in zip(*(c.to_pylist() for c in batch.columns)):
        n = len(ids) // 8
        yield size, Rows(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vs, np.int32).reshape(n, size)), np.frombuffer(fars, np.float32).reshape(n, -1)


def _search(spark, tiles: DataFrame, queries: dict[int, Anchors], positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Both searches of one block of anchors over all tiles."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = tiles.repartition(tasks, F.xxhash64("ids"))
    held = spark.sparkContext.broadcast(queries)

    def nearest(batches):
        searches = {size: (q, q.positives_of(positives)) for size, q in held.value.items()}
        for batch in batches:
            for size, rows, far in _opened(batch):
                if size not in searches:
                    continue
                q, best = searches[size]
                a, r, s = q.survivors(rows, far, best.least.astype(np.float64), np.full(len(q.rows), np.inf), True)
                other = q.rows.ids[a] != rows.ids[r]
                best.add(a[other], s[other], rows.ids[r[other]])
        for q, best in searches.values():
            yield pa.RecordBatch.from_arrays([pa.array(q.rows.ids[best.slot]), pa.array(best.id), pa.array(best.score)], ["anchor_id", "positive_id", "positive_score"])

    near = spread.mapInArrow(nearest, "anchor_id bigint, positive_id bigint, positive_score bigint")
    ranked = near.selectExpr("*", "row_number() OVER (PARTITION BY anchor_id ORDER BY positive_score DESC, positive_id) AS rank").where(F.col("rank") <= positives)
    # at most `positives` rows of each anchor of this block
    table = ranked.select("anchor_id", "positive_id", "positive_score").toArrow()
    anchor, positive, score = (np.asarray(table[c], dtype=np.int64) for c in table.column_names)
    least, most = -((-low * score) // 100), (high * score) // 100
    open_ = least <= most
    anchor, positive, score, least, most = (x[open_] for x in (anchor, positive, score, least, most))
    asked = {}
    for size, q in queries.items():
        order = np.argsort(q.rows.ids, kind="stable")
        at = order[np.minimum(np.searchsorted(q.rows.ids[order], anchor), len(order) - 1)]
        own = q.rows.ids[at] == anchor
        asked[size] = (at[own], positive[own], score[own], least[own], most[own])
    bands = spark.sparkContext.broadcast(asked)

    def between(batches):
        searches = {}
        for size, q in held.value.items():
            slot, positive, score, least, most = bands.value[size]
            if len(slot):
                searches[size] = (q, q.negatives_of(negatives, slot, least, most))
        for batch in batches:
            for size, rows, far in _opened(batch):
                if size not in searches:
                    continue
                q, best = searches[size]
                slot, _, _, least, most = bands.value[size]
                need, above = np.full(len(q.rows), np.inf), np.full(len(q.rows), -np.inf)
                np.minimum.at(need, slot, best.least.astype(np.float64))
                np.maximum.at(above, slot, most.astype(np.float64))
                a, r, s = q.survivors(rows, far, need, above, False)
                order = np.argsort(a, kind="stable")
                a, r, s = a[order], r[order], s[order]
                # every band of the anchor that a pair belongs to
                start, stop = np.searchsorted(a, slot, side="left"), np.searchsorted(a, slot, side="right")
                many = stop - start
                which = np.repeat(np.arange(len(slot)), many)
                pair = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
                fits = (s[pair] >= least[which]) & (s[pair] <= most[which]) & (rows.ids[r[pair]] != q.rows.ids[slot[which]])
                best.add(which[fits], s[pair[fits]], rows.ids[r[pair[fits]]])
        for size, (q, best) in searches.items():
            slot, positive, score, _, _ = bands.value[size]
            columns = (q.rows.ids[slot[best.slot]], positive[best.slot], best.id, score[best.slot], best.score)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = spread.mapInArrow(between, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS rank").where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
