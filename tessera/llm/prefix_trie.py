"""Prefix tries of conversations: one row per distinct prefix, with rollups over its subtree.

A conversation is a row of 16-byte labels, one a turn.  Equal conversations are one class with its least id, its size and
the digest of its ids.  Classes are dealt out by their first turns into prefix shards.  A shard is a succinct level-order trie: numpy
builds its LOUDS bits (each node's children as ones, then a zero, level by level) and its label array, the parents are read
off the bits, and totals are rolled up level by level from the last one with ``add.at``.  A prefix with more than
its share of all turns is no shard: it is split by the next turn, and these upper levels (the root is always one) are merged
separately by partial aggregates over the shards' top nodes.  Each such level costs one aggregation over the
classes under heavy prefixes.

The ids that end at a node are hashed in order without ever being gathered: ranges of sorted ids become strings of
bounded size, and a node's strings run through one SHA-256 stream.

Edges: a row without a conversation id is in no conversation; a null role or text is empty; turns of one number
(null comes first) are ordered by role, then by the MD5 of the text, and repeated rows are turns each; a conversation without turns is a
member of the root; a table without conversations has no nodes.  Labels are MD5 digests of role and text.  One conversation's
labels (16 bytes a turn) and one class are a row of one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: Turns of whole shards that are built into one trie at a time.
BLOCK = 1 << 19
#: A prefix is heavy above this share of a partition's turns, and never below the least.
SHARE, LEAST = 0.25, 4096
#: Characters of joined ids in one row.
STRETCH = 1 << 16
#: Prefixes of heavy nodes that are broadcast; more are joined by a shuffle.
FEW = 50_000

EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, top binary"


def words_in(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def sequences(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, labels, words) of every conversation, its turns in order; texts are reduced to labels before they move."""
    said = F.coalesce(F.col(text), F.lit(""))
    who = F.coalesce(F.col(role), F.lit(""))
    one = turns.where(F.col(id).isNotNull()).select(
        F.col(id).cast("bigint").alias("conv"),
        F.struct(F.col(turn).alias("turn"), who.alias("role"), F.md5(said).alias("text"), words_in(said).alias("words")).alias("t"),
    )
    ordered = one.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv", F.transform("t", lambda t: F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))).alias("labels"), F.col("t.words").alias("words"))


def digests(pairs: DataFrame) -> DataFrame:
    """(key, first, n, sha): of each binary ``key`` its least id, its ids, and the SHA-256 of them, ascending, comma-joined."""
    schema = "key binary, first bigint, n bigint, ids string"

    def stretches(batches):
        key, first, held, size = None, None, [], 0
        for batch in batches:
            rows = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key is not None and (k != key or size >= STRETCH):
                    rows.append((key, first, len(held), ",".join(held)))
                    held, size = [], 0
                if not held:
                    key, first = k, c
                held.append(str(c))
                size += len(held[-1]) + 1
            if rows:
                yield _batch(rows, ("key", "first", "n", "ids"), (pa.binary(), pa.int64(), pa.int64(), pa.string()))
        if held:
            yield _batch([(key, first, len(held), ",".join(held))], ("key", "first", "n", "ids"), (pa.binary(), pa.int64(), pa.int64(), pa.string()))

    def hashed(batches):
        key, first, n, sha = None, None, 0, None
        names, kinds = ("key", "first", "n", "sha"), (pa.binary(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = []
            for k, c, more, ids in zip(*(batch.column(x).to_pylist() for x in range(4))):
                if k != key:
                    if key is not None:
                        rows.append((key, first, n, sha.hexdigest()))
                    key, first, n, sha = k, c, 0, hashlib.sha256()
                sha.update(((b"," if n else b"") + ids.encode()))
                n += more
            if rows:
                yield _batch(rows, names, kinds)
        if key is not None:
            yield _batch([(key, first, n, sha.hexdigest())], names, kinds)

    parts = pairs.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(stretches, schema)
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, first bigint, n bigint, sha string")


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


class Louds:
    """A level-order unary degree sequence: node v's children are ones, closed by a zero; nodes are numbered by level."""

    def __init__(self, degrees: np.ndarray):
        self.n = len(degrees)
        bits = np.ones(int(degrees.sum()) + self.n, dtype=np.uint8)
        bits[np.cumsum(degrees) + np.arange(self.n)] = 0
        self.size, self.bits = len(bits), np.packbits(bits)

    def parents(self) -> np.ndarray:
        """The parent of every node that is somebody's child, in node order: the zeros before its one."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.size))
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        """Each node's children: the ones between its zero and the one before."""
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=self.size) == 0)
        return np.diff(np.r_[-1, zeros]) - 1


def build(rows: list[tuple]) -> dict[str, np.ndarray]:
    """The forest over classes (depth of its roots' parent, labels, words, n, conv, sha); its first nodes are those parents.

    Classes whose labels above ``base`` are equal share a parent.  Returns columns over all nodes below the parents.
    """
    base = np.array([r[0] for r in rows], dtype=np.int64)
    length = np.array([len(r[1]) // 16 for r in rows], dtype=np.int64)
    flat = np.frombuffer(b"".join(r[1] for r in rows), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    at = np.cumsum(length) - length
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    ranked = flat[order]
    code = np.empty(len(flat), dtype=np.int64)
    code[order] = np.cumsum(np.r_[0, np.any(ranked[1:] != ranked[:-1], axis=1).astype(np.int64)])
    kinds = int(code.max()) + 1
    said = np.concatenate([np.asarray(r[2], dtype=np.int64) for r in rows])
    tops: dict[bytes, int] = {}
    node = np.array([tops.setdefault(r[1][: 16 * r[0]], len(tops)) for r in rows], dtype=np.int64)
    live, depth, total = np.arange(len(rows)), base.copy(), len(tops)
    levels, labels, words, depths = [np.array([0, total])], [np.full(total, -1)], [np.zeros(total, dtype=np.int64)], [np.zeros(total, dtype=np.int64)]
    degree, last = [], (0, total)
    while True:
        live = live[depth[live] < length[live]]
        here = at[live] + depth[live]
        found, first, back = np.unique(node[live] * kinds + code[here], return_index=True, return_inverse=True)
        degree.append(np.bincount(found // kinds - last[0], minlength=last[1] - last[0]))
        if not len(live):
            break
        labels.append(found % kinds)
        words.append(said[here[first]])
        depths.append(depth[live[first]] + 1)
        node[live] = total + back
        depth[live] += 1
        last = (total, total + len(found))
        levels.append(np.array(last))
        total += len(found)
    trie = Louds(np.concatenate(degree))
    parent = np.r_[np.full(len(tops), -1), trie.parents()]
    children = trie.degrees()
    words_, depths_ = np.concatenate(words), np.concatenate(depths)
    n = np.zeros(total, dtype=np.int64)
    conv = np.full(total, np.iinfo(np.int64).max)
    np.add.at(n, node, np.array([r[3] for r in rows], dtype=np.int64))
    np.minimum.at(conv, node, np.array([r[4] for r in rows], dtype=np.int64))
    leaves = (children == 0).astype(np.int64)
    saved = np.zeros(total, dtype=np.int64)
    for a, b in reversed(levels[1:]):
        saved[a:b] += (n[a:b] - 1) * words_[a:b]
        up = parent[a:b]
        np.add.at(n, up, n[a:b])
        np.add.at(leaves, up, leaves[a:b])
        np.add.at(saved, up, saved[a:b])
        np.minimum.at(conv, up, conv[a:b])
    ends = np.full(total, EMPTY, dtype=object)
    ends[node] = [r[5] for r in rows]
    below = slice(len(tops), total)
    of_top = parent[below] < len(tops)
    names = np.array([*tops, None], dtype=object)[:-1]
    return {
        "depth": depths_[below], "conv_id": conv[below], "parent_conv_id": np.ma.array(conv[np.maximum(parent[below], 0)], mask=of_top), "n_convs": n[below], "n_children": children[below],
        "n_leaves": leaves[below], "saved_tokens": saved[below], "ends_sha256": ends[below], "top": np.where(of_top, names[np.minimum(parent[below], len(tops) - 1)], None),
    }


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes sorted by shard, in blocks of whole shards, as nodes."""
    held, turns, shard = [], 0, None
    for batch in batches:
        for base, labels, words, n, conv, sha in zip(*(batch.column(k).to_pylist() for k in range(6))):
            own = labels[: 16 * (base + 1)]
            if own != shard and turns >= BLOCK:
                yield from _nodes(held)
                held, turns = [], 0
            shard = own
            held.append((base, labels, words, n, conv, sha))
            turns += len(words)
    if held:
        yield from _nodes(held)


def _nodes(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    columns = build(rows)
    kinds = (*[pa.int64()] * 7, pa.string(), pa.binary())
    arrays = []
    for (name, column), kind in zip(columns.items(), kinds):
        mask = np.ma.getmaskarray(column) if isinstance(column, np.ma.MaskedArray) else None
        arrays.append(pa.array(np.asarray(column), kind, mask=mask))
    whole = pa.RecordBatch.from_arrays(arrays, list(columns))
    for k in range(0, whole.num_rows, 50_000):
        yield whole.slice(k, 50_000)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def trie(seqs: DataFrame) -> DataFrame:
    """All nodes of the trie over (conv, labels, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = seqs.sparkSession
    whole = materialise(seqs.select("conv", F.unhex(F.array_join("labels", "")).alias("labels"), "words"), "trie-sequences")
    ends = digests(whole.select(F.unhex(F.md5("labels")).alias("key"), F.col("conv").alias("id")))
    classes = materialise(ends.join(whole, ends["first"] == whole["conv"]).select("labels", "words", "n", "conv", "sha", F.size("words").alias("depth")), "trie-classes")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (turns,) = classes.agg(F.coalesce(F.sum("depth"), F.lit(0))).first()
    most = max(LEAST, int(SHARE * turns / partitions))

    # upper levels: the root, then every prefix that is heavy
    heavy, classes_at, level = [], classes.withColumn("base", F.lit(0)), 0
    while True:
        level += 1
        prefix = F.expr(f"substring(labels, 1, {16 * level})")
        under = classes_at.where((F.col("base") == level - 1) & (F.col("depth") >= level))
        found = under.groupBy(prefix.alias("prefix")).agg(F.sum("depth").alias("turns"), F.max(F.col("words")[level - 1]).alias("said")).where(F.col("turns") > most).select("prefix", "said")
        found = materialise(found, f"trie-heavy-{level}")
        rows = found.count()
        if not rows:
            break
        heavy.append((found, rows))
        mark = _small(found.select(F.col("prefix").alias("_p")), rows)
        classes_at = classes_at.join(mark, (F.col("base") == level - 1) & (F.col("depth") >= level) & (prefix == F.col("_p")), "left")
        classes_at = classes_at.withColumn("base", F.when(F.col("_p").isNotNull(), F.lit(level)).otherwise(F.col("base"))).drop("_p")

    shards = classes_at.where(F.col("depth") > F.col("base")).withColumn("shard", F.expr("substring(labels, 1, 16 * (base + 1))"))
    shards = shards.repartition("shard").sortWithinPartitions("shard").select("base", "labels", "words", "n", "conv", "sha")
    nodes = materialise(shards.mapInArrow(_forests, NODES), "trie-nodes")
    stops = classes_at.where(F.col("depth") == F.col("base"))

    # the upper levels from below: each is an aggregate over the tops of shards, the upper nodes under it and what ends at it
    measures = ("n_convs", "n_leaves", "saved_tokens")
    upper, below = [], None
    for depth in range(len(heavy), -1, -1):
        prefix = F.expr(f"substring(top, 1, {16 * depth})")
        parts = nodes.where(F.length("top") == 16 * depth).select(F.col("top").alias("prefix"), "conv_id", *measures, F.lit(1).alias("child"), F.lit(None).cast("string").alias("sha"))
        ending = stops.where(F.col("depth") == depth).select(F.col("labels").alias("prefix"), F.col("conv").alias("conv_id"), F.col("n").alias("n_convs"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.lit(0).alias("child"), "sha")
        parts = parts.unionByName(ending)
        if below is not None:
            parts = parts.unionByName(below.select(prefix.alias("prefix"), "conv_id", *measures, F.lit(1).alias("child"), F.lit(None).cast("string").alias("sha")))
        merged = parts.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), *(F.sum(m).alias(m) for m in measures), F.sum("child").alias("n_children"), F.max("sha").alias("sha"))
        own = F.lit(0)
        if depth:
            found, rows = heavy[depth - 1]
            merged = merged.join(_small(found, rows), "prefix")
            own = (F.col("n_convs") - 1) * F.col("said")
        below = merged.select(
            F.col("prefix").alias("top"), F.lit(depth).cast("bigint").alias("depth"), "conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
            (F.col("saved_tokens") + own).alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
        )
        upper.append(below)
    tops = upper[0]
    for more in upper[1:]:
        tops = tops.unionByName(more)
    tops = materialise(tops, "trie-upper")
    named = _small(tops.select(F.col("top").alias("_p"), F.col("conv_id").alias("_c")), 1 + sum(rows for _, rows in heavy))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    low = nodes.join(named, nodes["top"] == F.col("_p"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_c"))
    high = tops.withColumn("_up", F.expr("CASE WHEN depth > 0 THEN substring(top, 1, 16 * (depth - 1)) END")).join(named, F.col("_up") == F.col("_p"), "left").withColumn("parent_conv_id", F.col("_c"))
    return low.select(*columns).unionByName(high.select(*columns))
