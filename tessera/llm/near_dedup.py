"""Near-duplicates by HyperMinHash.

1. Each text becomes the set of its word shingles (64-bit hashes).  Bucket i of a sketch holds the minimum of the set
   under permutation i (multiply-add on 64 bits, so that short texts fill every bucket), compressed to the count of
   its leading zeros and 10 mantissa bits: 16 bits a register.
2. Equal sets collapse to one representative, the smallest doc_id.
3. ``ROWS`` registers make a band, ``BANDS`` bands a sketch; sets that share a band key are candidates.
4. Within a bucket, members first meet its leader, drawn by one order for all bands, so that a large group's members
   mostly name the same one; the Jaccard estimate is corrected for register collisions; pairs that pass are verified on
   full sets, and verified links make components.
5. Buckets that still hold more than one component are open.  Their members are compared in blocks of bounded bytes,
   block against block inside a task: sketches first, then, of the members that have a candidate in another component,
   the full sets.  Every pair across components that passes the estimate is verified, at its first shared band only,
   unless links found there join the two already; only the fact of a link comes out.  So every candidate pair that could
   change a component is tested, pairs inside a component, the bulk in a large group, are never made, and a large group
   costs rows in proportion to its blocks.

A pair at similarity 0.8 misses every band with probability (1 - 0.8**5)**40 = 1.2e-7 and falls below the
estimate's bound (0.66, five standard deviations) with about 3e-7.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer words than the shingle width
are one shingle; a row without doc_id is in no group and is kept; rows that share a doc_id are one document; an empty
table gives an empty result; other columns are passed over or, in ``filter_documents``, kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Among, WordHashes, materialise, mix64, shingles, slices, unused, utf8
from tessera.llm.components import components

BANDS, ROWS = 40, 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
BOUND = 0.66
#: Shingles per block when the permutations are applied.
_BLOCK = 512
#: Bytes of sketches and sets a block, when the members of a bucket are compared.
BLOCK_BYTES = 1 << 20
#: Fixed bits that draw a bucket's leader: one order for all bands, so that a group's buckets mostly name the same one.
DRAW = 0x5DEECE66D1234567


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values = mix64(seeds)
    return values[:BUCKETS] | np.uint64(1), values[BUCKETS:]


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a nonempty set."""
    a, b = _permutations() if not _cache else _cache[0]
    if not _cache:
        _cache.append((a, b))
    least = None
    for at in range(0, len(hashes), _BLOCK):
        block = (hashes[at : at + _BLOCK, None] * a + b).min(axis=0)
        least = block if least is None else np.minimum(least, block)
    zeros = np.clip(64 - np.frexp(least.astype(np.float64))[1], 0, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


_cache: list = []


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of different minima agree, for sets of n and m elements."""
    level = np.arange(0, 40, dtype=np.float64)
    at = lambda size: np.power(1 - np.exp2(-(level + 1)), size[:, None]) - np.power(1 - np.exp2(-level), size[:, None])
    return (at(n.astype(np.float64)) * at(m.astype(np.float64))).sum(axis=1) / 2**MANTISSA


def estimate(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    """The collision-corrected Jaccard estimate of two sketches."""
    left = np.frombuffer(b"".join(a.to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
    right = np.frombuffer(b"".join(b.to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
    chance = collision_rate(n.to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False))
    return pa.array(((left == right).mean(axis=1) - chance) / (1 - chance))


def intersection(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sizes of the intersections of two columns of packed sorted sets."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        left, right = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        at = np.searchsorted(right, left)
        at[at == len(right)] = 0
        out.append(int((right[at] == left).sum()))
    return pa.array(out, type=pa.int64())


class _Block:
    """Members of one bucket: documents, their components, set sizes and registers."""

    def __init__(self, members: list[dict]) -> None:
        self.members = members
        self.doc, self.component, self.n = (np.array([m[c] for m in members], dtype=np.int64) for c in ("doc", "component", "n"))
        self.registers = np.frombuffer(b"".join(m["sketch"] for m in members), dtype=np.uint16).reshape(-1, BUCKETS)

    def partners(self, k: int, other: _Block, band: int) -> np.ndarray:
        """Members of another component whose estimate passes and whose first shared band is this one."""
        agree = (other.registers == self.registers[k]).sum(axis=1)
        at = np.flatnonzero((agree >= BOUND * BUCKETS) & (other.component != self.component[k]))
        if len(at):
            chance = collision_rate(np.full(len(at), self.n[k]), other.n[at])
            at = at[(agree[at] / BUCKETS - chance) / (1 - chance) >= BOUND]
        if len(at):
            shared = (other.registers[at].reshape(-1, BANDS, ROWS) == self.registers[k].reshape(BANDS, ROWS)).all(axis=2)
            at = at[shared.argmax(axis=1) == band]
        return at


def _blocks(left: pa.Array, right: pa.Array) -> Iterator[tuple[_Block, _Block, bool]]:
    """The two blocks of each row; a null right one stands for the left one itself, whose pairs count once."""
    for x, y in zip(left, right):
        x = _Block(x.as_py())
        yield x, _Block(y.as_py()) if y.is_valid else x, not y.is_valid


def _active(band: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
    """The documents of two blocks that have a candidate partner in the other."""
    out = []
    for number, (x, y, one) in zip(band.to_pylist(), _blocks(left, right)):
        found: set[int] = set()
        for k in range(len(x.doc)):
            at = x.partners(k, y, number)
            if one:
                at = at[at > k]
            if len(at):
                found.add(int(x.doc[k]))
                found.update(y.doc[at].tolist())
        out.append(sorted(found))
    return pa.array(out, pa.list_(pa.int64()))


def _linked(percent: int):
    """The pairs of components of two blocks that a verified link joins, without those that links here already join."""

    def run(band: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for number, (x, y, one) in zip(band.to_pylist(), _blocks(left, right)):
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.setdefault(c, c) != c:
                    c = root[c]
                return c

            found = []
            sets = [np.frombuffer(m["set"], dtype=np.uint64) for m in y.members]
            for k in range(len(x.doc)):
                mine = np.frombuffer(x.members[k]["set"], dtype=np.uint64)
                for j in x.partners(k, y, number):
                    if one and j < k:
                        continue
                    a, b = find(int(x.component[k])), find(int(y.component[j]))
                    if a == b:
                        continue
                    at = np.searchsorted(sets[j], mine)
                    at[at == len(sets[j])] = 0
                    common = int((sets[j][at] == mine).sum())
                    if 100 * common >= percent * (len(mine) + len(sets[j]) - common):
                        root[b] = a
                        found.append({"a": int(x.component[k]), "b": int(y.component[j])})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    run.__annotations__ = {"band": pa.Array, "left": pa.Array, "right": pa.Array, "return": pa.Array}
    return run


def _compared(members: DataFrame, weight: str, compare, kind: str) -> DataFrame:
    """(key, found) from every two blocks of each bucket of ``members`` (key, band, doc, component, n, sketch, ...).

    A block holds about ``BLOCK_BYTES`` of ``weight``; a bucket of several blocks is compared block by block, each pair
    of blocks a row of its own.  Blocks are dealt out by a hash of their own, so a large bucket's spread over all tasks.
    """
    sizes = materialise(members.groupBy("key").agg(F.ceil(F.sum(F.expr(weight)) / BLOCK_BYTES).cast("int").alias("blocks")), "near-sizes")
    held = [F.col(c) for c in members.columns if c not in ("key", "band")]
    placed = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    firsts = [F.first(c).alias(c) for c in ("key", "band", "block", "blocks")]
    blocks = placed.groupBy(F.struct("key", "block").alias("home")).agg(*firsts, F.collect_list(F.struct(*held)).alias("left"))
    alone = blocks.select("key", "band", "left", F.expr("CASE WHEN false THEN left END").alias("right"))
    met = blocks.where("block + 1 < blocks").withColumn("other", F.explode(F.expr("sequence(block + 1, blocks - 1)")))
    right = blocks.where("blocks > 1").select("key", F.col("block").alias("other"), F.col("left").alias("right"))
    both = alone.unionByName(met.join(right, ["key", "other"]).select("key", "band", "left", "right"))
    return both.select("key", F.explode(F.arrow_udf(compare, f"array<{kind}>")("band", "left", "right")).alias("found"))


def _across(members: DataFrame, first: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links between components of ``first``.

    Only buckets of several components are open.  Sketches go first: they leave the members that have a candidate in
    another component at that bucket; only these bring their full sets there.
    """
    placed = members.select("key", "band", "doc").join(first.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = materialise(placed, "near-placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    opened = materialise(placed.join(open_keys, "key", "left_semi"), "near-open")
    active = _compared(opened.join(sketches, "doc"), "octet_length(sketch) + 24", _active, "bigint")
    active = materialise(active.select("key", F.col("found").alias("doc")).distinct(), "near-active")
    wanted = opened.join(active, ["key", "doc"], "left_semi").join(sketches, "doc").join(sets, "doc")
    links = _compared(wanted, "octet_length(sketch) + octet_length(set) + 24", _linked(percent), "struct<a: bigint, b: bigint>")
    return materialise(links.select("found.a", "found.b").distinct(), "near-across")


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            size, key, sketch = [], [], []
            for text in utf8(batch):
                hashes = shingles((text or b"").lower().split(), width, memo)
                size.append(len(hashes))
                key.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                sketch.append(registers(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary())], names=["doc", "n", "key", "sketch"])

    return run


def _sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batch.filter(wanted(batch.column(2))) for batch in batches):
            packed = [shingles((text or b"").lower().split(), width, memo).tobytes() for text in utf8(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc", "set"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, sketch) -> (key, band, doc): a key is a 63-bit hash of band number and registers."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            regs = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), regs.shape[:2]).copy()
            for r in range(ROWS):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r])
            docs = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(1)).astype(np.int64).ravel()), pa.array(band), pa.array(docs)], names=["key", "band", "doc"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("set").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").withColumn("common", F.arrow_udf(intersection, "bigint")("sa", "sb"))
    return met.where(F.expr(f"100 * common >= {percent} * (octet_length(sa) div 8 + octet_length(sb) div 8 - common)")).select("a", "b")


def groups(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, component) for every row: the size of its set and the smallest doc_id that links reach."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    features = materialise(rows.mapInArrow(_features(width), "doc bigint, n bigint, key binary, sketch binary"), "near-features")
    linked = features.where("n > 0 AND doc IS NOT NULL")
    classes = materialise(linked.groupBy("key").agg(F.min("doc").alias("rep"), F.first("sketch").alias("sketch"), F.first("n").alias("n")), "near-classes")

    sketches = classes.select(F.col("rep").alias("doc"), "sketch", "n")
    bands = sketches.select("doc", "sketch").mapInArrow(_bands, "key bigint, band int, doc bigint")
    drawn = F.expr(f"doc ^ {DRAW}")
    shared = bands.groupBy("key").agg(F.min(drawn).alias("x"), F.max(drawn).alias("y")).where("x <> y").select("key", F.expr(f"x ^ {DRAW}").alias("leader"))
    members = materialise(bands.join(shared, "key"), "near-members")

    pairs = members.where("doc <> leader").select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()
    sa = sketches.select(F.col("doc").alias("a"), F.col("sketch").alias("ka"), F.col("n").alias("na"))
    sb = sketches.select(F.col("doc").alias("b"), F.col("sketch").alias("kb"), F.col("n").alias("nb"))
    scored = pairs.join(sa, "a").join(sb, "b").select("a", "b", F.arrow_udf(estimate, "double")("ka", "kb", "na", "nb").alias("score")).where(F.col("score") >= BOUND)
    scored = materialise(scored, "near-scored")
    # a text whose document only seems to be a member gives a set that no pair asks for
    seen = Among(members, "doc")
    placed = rows.where("doc IS NOT NULL").select("doc", "text", seen.place(F.col("doc")).alias("place"))
    sets = materialise(placed.mapInArrow(_sets(width, seen.test()), "doc bigint, set binary").where("octet_length(set) > 0"), "near-sets")
    first = components(_verify(scored, sets, percent))
    joined = _across(members, first, sketches, sets, percent)
    second = components(joined).select(F.col("node").alias("component"), F.col("component").alias("root"))
    final = first.join(second, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    lone = second.join(first.select(F.col("component")).distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("root").alias("component"))
    found = final.unionByName(lone).withColumnRenamed("node", "rep")

    named = classes.select("key", "rep").join(found, "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = features.select("doc", "n", "key").join(named, "key", "left")
    return out.select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def filter_documents(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the members of each group but its smallest doc_id; rows without doc_id stay."""
    own = unused(docs, "doc")
    gone = materialise(groups(docs, width, percent, doc_id, text).where("doc <> component").select(F.col("doc").alias(own)), "near-gone")
    key = F.col(f"`{doc_id}`").cast("bigint")
    seen = Among(gone, own)(key)
    # texts are sent only where the document may be among those that go
    return docs.where(~seen).unionByName(docs.where(seen).join(gone, key == F.col(own), "left_anti"))
