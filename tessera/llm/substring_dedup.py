"""Exact removal of 50-byte strings that also start in a document with a smaller doc_id.

A suffix sort over a difference cover must ship every sampled suffix; for 50-byte matches its cheapest cover takes 6 of
31 positions, and each level of recursion ships them again, which is beyond the disk set for this operator (README; the
cover can be had as ``sample="cover"``).  The sample here is by default content-defined, a string synchronising set
(Kempa and Kociumaka, 2019), which serves the same end with about one position in 14: of the 27 blocks of 24 bytes in a
50-byte string, the one with the least hash.  Equal strings choose the same block at the same offset, so:

1. sample: texts are dealt out to shelves of bounded size; the distinct blocks of each text are named by a hash and
   sent to buckets of names;
2. a bucket answers each shelf with a bitmap of the names that two texts or more have: no string under the others
   repeats, and they go no further;
3. merge: each remaining sampled position brings its context, which holds every 50-byte string that it stands for.
   Equal contexts of a shelf travel once, with their smallest document; all strings of a name meet in its bucket,
   sorted by hash and document, and neighbours are compared byte by byte;
4. strings whose least doc_id is smaller than their own mark their place; overlapping places are merged.

A name of more than ``HOT`` texts (a passage that very many documents share) is dealt out by whole strings, not by
name, so its texts do not meet in one bucket: strings inside the passage then travel once a shelf, and all others are
spread by their own hash.  Shelves and buckets follow the number of bytes; each is one task's work of bounded size (a
single text may be longer).  All three passes over the texts read one exchange.

Texts are addressed by (doc_id, content): only the smallest doc_id of equal texts takes part; every later copy is
removed whole.

Defined results: a null text is empty; texts of fewer than 50 bytes are kept whole; a row without doc_id has no smaller
document and is no smaller document: it is kept whole; rows that share a doc_id are one document's versions, each
judged by its own text; a long text is one row of one task; an empty table gives an empty result; other columns are
passed over.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, mix64

LENGTH = 50
#: Block of the content-defined sample; block, period and residues of the difference cover.
BLOCK = 24
COVER_BLOCK, COVER_PERIOD, COVER = 20, 31, (1, 5, 11, 24, 25, 27)
#: Text bytes a shelf, name bytes a bucket, texts from which on a name is dealt out by strings.
SHELF_BYTES, BUCKET_BYTES, HOT = 8 << 20, 16 << 20, 1000
#: Least bytes of a shelf and of a bucket, where there are more tasks than work: their product is the number of messages.
LEAST_SHELF, LEAST_BUCKET = 512 << 10, 128 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_TOP = np.uint64(0xFFFFFFFFFFF00000)
_STEP = 1 << 18


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width``-byte strings of a byte array (or of each row of a matrix), by doubling."""
    value, have, out, done = _BYTES[data], 1, None, 0
    size = data.shape[-1] - width + 1
    power = np.array([_BASE])  # an array: products wrap without a warning
    while True:
        if width & have:
            piece = value[..., done : done + size]
            out = piece.copy() if out is None else out * power + piece
            done += have
        if have * 2 > width:
            return mix64(out)
        value = value[..., : value.shape[-1] - have] * power + value[..., have:]
        power, have = power * power, have * 2


def anchors(data: np.ndarray, sample: str = "content") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, name, first start, last start) of each sampled block of one text; starts are those of its strings."""
    n = len(data) - LENGTH + 1
    none = np.empty(0, dtype=np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    if sample == "cover":
        hashes = rolling(data, COVER_BLOCK)
        at = np.flatnonzero(np.isin(np.arange(len(hashes)) % COVER_PERIOD, COVER))
        return at, hashes[at], np.maximum(at - (COVER_PERIOD - 1), 0), np.minimum(at, n - 1)
    choices = LENGTH - BLOCK + 1
    at, name, lo, hi = [], [], [], []
    for start in range(0, n, _STEP):
        stop = min(n, start + _STEP)
        hashes = rolling(data[start : stop + LENGTH - 1], BLOCK)
        order = (hashes & _TOP) | np.arange(len(hashes), dtype=np.uint64)
        least, span = order, 1
        while span * 2 <= choices:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        least = np.minimum(least[: stop - start], least[choices - span : choices - span + stop - start])
        first = np.concatenate(([0], np.flatnonzero(np.diff(least)) + 1))
        where = (least[first] & ~_TOP).astype(np.int64)
        at.append(where + start)
        name.append(hashes[where])
        lo.append(first + start)
        hi.append(np.append(first[1:], stop - start) - 1 + start)
    return tuple(np.concatenate(x) for x in (at, name, lo, hi))


def _cuts(values: np.ndarray) -> np.ndarray:
    """The edges of runs of equal neighbours."""
    return np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)])) if len(values) else np.zeros(1, dtype=np.int64)


def _pack40(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _texts(left: pa.Table, right: pa.Table) -> tuple[list[tuple[int, bytes]], list[bytes]]:
    """The distinct (doc, content) of a shelf that take part, in order, and their texts; both passes number them alike."""
    copies = {(d, c) for d, c in zip(_column(right, "doc"), _column(right, "content")) if c is not None}
    held = {}
    for doc, content, text in zip(_column(left, "doc"), _column(left, "content"), left.column("text").cast(pa.binary()).to_pylist()):
        if doc is not None and text is not None and len(text) >= LENGTH and (doc, content) not in copies:
            held[doc, content] = text
    keys = sorted(held)
    return keys, [held[k] for k in keys]


class _Names:
    """The distinct names of each text of a shelf, by bucket, text and name."""

    def __init__(self, texts: list[bytes], n_buckets: int, sample: str) -> None:
        self.found = [anchors(np.frombuffer(text, dtype=np.uint8), sample) for text in texts]
        unique = [np.unique(f[1], return_inverse=True) for f in self.found]
        self.inverse = [u[1] for u in unique]
        self.edge = np.concatenate(([0], np.cumsum([len(u[0]) for u in unique], dtype=np.int64))).astype(np.int64)
        self.name = np.concatenate([u[0] for u in unique]) if unique else np.empty(0, dtype=np.uint64)
        bucket = (self.name % np.uint64(n_buckets)).astype(np.int32)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.order]


def _names(n_buckets: int, sample: str):
    """A shelf -> per bucket: the names of its texts, each once a text (40 bits beside the bucket; chance meetings cost time only)."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts = _texts(left, right)
        own = _Names(texts, n_buckets, sample)
        bucket, names = [], []
        short = (own.name // np.uint64(n_buckets)) & np.uint64((1 << 40) - 1)
        edges = _cuts(own.bucket)
        for a, b in zip(edges[:-1], edges[1:]):
            bucket.append(int(own.bucket[a]))
            names.append(_pack40(short[own.order[a:b]]).tobytes())
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "shelf": pa.array([key[0].as_py()] * len(bucket), pa.int32()), "names": pa.array(names, pa.binary())})

    return run


_NAMES = "bucket int, shelf int, names binary"
#: What a shelf is told: copies by (doc, content), with bucket -1, or what a bucket has to say.
_TOLD = "shelf int, bucket int, data binary"


def _repeated(hot: int):
    """A bucket of names -> for each shelf, bitmaps of its names there: those of two texts or more, those of very many."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpack40(x) for x in _column(table, "names")]
        name = np.concatenate(parts)
        order = np.argsort(name)
        edges = _cuts(name[order])
        size = np.diff(edges)
        flags = np.zeros(len(name), dtype=np.uint8)
        flags[order] = np.repeat((size > 1).astype(np.uint8) + (size > hot), size)
        shelf, data, at = [], [], 0
        for number, part in zip(_column(table, "shelf"), parts):
            own = flags[at : at + len(part)]
            at += len(part)
            if own.any():
                shelf.append(number)
                data.append(np.packbits(own > 0).tobytes() + np.packbits(own > 1).tobytes())
        return pa.table({"shelf": pa.array(shelf, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(shelf), pa.int32()), "data": pa.array(data, pa.binary())})

    return run


def _covered(lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Which bytes of a context its strings cover."""
    shift = np.arange(width)
    return (shift >= lo.astype(np.int64)[:, None]) & (shift < hi.astype(np.int64)[:, None] + LENGTH)


def _digest(context: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each context with its range of strings."""
    wide = np.zeros((len(context), -(-context.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : context.shape[1]] = context
    out = lo.astype(np.uint64) * np.uint64(256) + hi
    for column in wide.view(np.uint64).T:
        out = mix64(out * _BASE + column)
    return out


def _runs(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(text, from, to) of string starts, merged where they touch."""
    order = np.lexsort((first, owner))
    owner, first, last = owner[order], first[order], last[order]
    if not len(owner):
        return np.empty((0, 3), dtype=np.uint32)
    line = owner.astype(np.int64) * (1 << 33)  # texts are shorter, so runs of different texts never touch
    reach = np.maximum.accumulate(line + last)
    new = np.concatenate(([True], line[1:] + first[1:] > reach[:-1] + 1))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(owner)) - 1
    return np.stack((owner[begin], first[begin], reach[end] - line[end]), axis=1).astype(np.uint32)


def _contexts(n_buckets: int, sample: str):
    """A shelf and what its buckets said -> per bucket: the contexts that must meet; runs settled within the shelf ride along."""
    side = LENGTH - (COVER_BLOCK if sample == "cover" else BLOCK)
    width = LENGTH + side

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts = _texts(left, right)
        own = _Names(texts, n_buckets, sample)
        flags = np.zeros(len(own.name), dtype=np.uint8)
        for bucket, data in zip(_column(right, "bucket"), _column(right, "data")):
            if data is not None:
                a, b = np.searchsorted(own.bucket, [bucket, bucket + 1])
                bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(2, -1), axis=1)[:, : b - a]
                flags[own.order[a:b]] = bits[0] + bits[1]
        rows = []
        for k, (text, (at, name, lo, hi)) in enumerate(zip(texts, own.found)):
            flag = flags[own.edge[k] + own.inverse[k]]
            for hot in (False, True):
                take = flag == 1 + hot
                if not take.any():
                    continue
                a, n, x, y = at[take], name[take], lo[take], hi[take]
                if hot:  # one string a context
                    times = y - x + 1
                    a, n = np.repeat(a, times), np.repeat(n, times)
                    x = y = np.repeat(x - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                padded = np.concatenate((np.zeros(side, dtype=np.uint8), np.frombuffer(text, dtype=np.uint8), np.zeros(side, dtype=np.uint8)))
                context = np.lib.stride_tricks.sliding_window_view(padded, width)[a]
                rows.append((n, np.full(len(a), k, dtype=np.int64), a, (x - a + side).astype(np.uint8), (y - a + side).astype(np.uint8), context, np.full(len(a), hot)))
        if not rows:
            return _EMPTY_CONTEXTS
        name, owner, at, lo, hi, context, hot = (np.concatenate(x) for x in zip(*rows))
        context[~_covered(lo, hi, width)] = 0
        doc = np.array([k[0] for k in keys], dtype=np.int64)
        digest = _digest(context, lo, hi)
        order = np.lexsort((doc[owner], digest))
        edges = _cuts(digest[order])
        lead = np.empty(len(order), dtype=np.int64)
        lead[order] = np.repeat(order[edges[:-1]], np.diff(edges))
        settled = (doc[owner] > doc[owner[lead]]) & (lo == lo[lead]) & (hi == hi[lead])
        which = np.flatnonzero(settled)
        settled[which] = (context[which] == context[lead[which]]).all(axis=1)
        start = at - side
        local = _runs(owner[settled], (start + lo)[settled], (start + hi)[settled])
        going = np.flatnonzero(~settled)
        deal = name[going]
        single = np.flatnonzero(hot[going])
        if len(single):
            index = going[single]
            deal[single] = rolling(context[index[:, None], lo[index].astype(np.int64)[:, None] + np.arange(LENGTH)], LENGTH)[:, 0]
        bucket = (deal % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        going, bucket = going[order], bucket[order]
        bytes_of = _covered(lo, hi, width)
        edges = _cuts(bucket)
        out = {c: [] for c in ("bucket", "who", "doc", "count", "at", "lo", "hi", "context", "runs")}
        for a, b in zip(edges[:-1], edges[1:]):
            part = going[a:b]
            part = part[np.argsort(owner[part], kind="stable")]
            who, count = np.unique(owner[part], return_counts=True)
            out["bucket"].append(int(bucket[a]))
            for c, values in (("who", who.astype(np.uint32)), ("doc", doc[who]), ("count", count.astype(np.uint32)), ("at", at[part].astype(np.uint32)), ("lo", lo[part]), ("hi", hi[part]), ("context", context[part][bytes_of[part]])):
                out[c].append(values.tobytes())
            out["runs"].append(None)
        if len(local):
            out["bucket"].append(key[0].as_py() % n_buckets)
            for c in ("who", "doc", "count", "at", "lo", "hi", "context"):
                out[c].append(b"")
            out["runs"].append(local.tobytes())
        return pa.table({"bucket": pa.array(out.pop("bucket"), pa.int32()), "shelf": pa.array([key[0].as_py()] * len(out["who"]), pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

    return run


_CONTEXTS = "bucket int, shelf int, who binary, doc binary, count binary, at binary, lo binary, hi binary, context binary, runs binary"
_EMPTY_CONTEXTS = pa.table({c.split()[0]: pa.array([], pa.int32() if c.endswith(" int") else pa.binary()) for c in _CONTEXTS.split(", ")})


def _places(sample: str):
    """A bucket of contexts -> for each shelf, the runs of string starts whose string starts in a smaller document."""
    side = LENGTH - (COVER_BLOCK if sample == "cover" else BLOCK)
    width = LENGTH + side

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shelves, runs = [], []
        packed = {c: _column(table, c) for c in table.column_names}
        for shelf, settled in zip(packed["shelf"], packed["runs"]):
            if settled:
                shelves.append(shelf)
                runs.append(settled)
        load = lambda c, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in packed[c]])
        count = load("count", np.uint32)
        who, doc = np.repeat(load("who", np.uint32), count).astype(np.int64), np.repeat(load("doc", np.int64), count)
        home = np.repeat(np.array(packed["shelf"], dtype=np.int64), [len(x) // 4 for x in packed["at"]])
        at, lo, hi = load("at", np.uint32).astype(np.int64), load("lo", np.uint8), load("hi", np.uint8)
        context = np.zeros((len(at), width), dtype=np.uint8)
        context[_covered(lo, hi, width)] = load("context", np.uint8)
        packed.clear()
        hit = _later(context, doc, lo, hi)
        if len(hit[0]):
            row, offset = hit
            begin = at[row] - side + offset
            both = home[row] * (1 << 31) + who[row]
            found, begin_of = np.unique(both, return_inverse=True)
            merged = _runs(begin_of, begin, begin)
            where = found[merged[:, 0].astype(np.int64)]
            for number in np.unique(where >> 31):
                mine = merged[where >> 31 == number]
                mine[:, 0] = (where[where >> 31 == number] & ((1 << 31) - 1)).astype(np.uint32)
                shelves.append(int(number))
                runs.append(mine.tobytes())
        return pa.table({"shelf": pa.array(shelves, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(shelves), pa.int32()), "data": pa.array(runs, pa.binary())})

    return run


def _later(context: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of each string that also stands in a context of a smaller document."""
    row, offset, value = [], [], []
    for a in range(0, len(doc), 4096):
        hashes = rolling(context[a : a + 4096], LENGTH)
        shift = np.arange(hashes.shape[1])
        held = (shift >= lo[a : a + 4096, None]) & (shift <= hi[a : a + 4096, None])
        r, s = np.nonzero(held)
        row.append((r + a).astype(np.int32))
        offset.append(s.astype(np.uint8))
        value.append(hashes[held])
    if not row:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    row, offset, value = np.concatenate(row), np.concatenate(offset), np.concatenate(value)
    order = np.lexsort((doc[row], value))
    row, offset, value = row[order], offset[order], value[order]
    edges = _cuts(value)
    lead = np.repeat(edges[:-1], np.diff(edges))
    later = np.flatnonzero(doc[row] > doc[row[lead]])
    views = np.lib.stride_tricks.sliding_window_view(context, LENGTH, axis=1)
    same = np.empty(len(later), dtype=bool)
    for a in range(0, len(later), 50_000):
        part = later[a : a + 50_000]
        same[a : a + 50_000] = (views[row[part], offset[part]] == views[row[lead[part]], offset[lead[part]]]).all(axis=1)
    hit = later[same]
    for index in later[~same]:  # different strings under one hash: compare with all of that hash, by bytes
        own = views[row[index], offset[index]]
        if any(doc[row[o]] < doc[row[index]] and (views[row[o], offset[o]] == own).all() for o in range(lead[index], index)):
            hit = np.append(hit, index)
    return row[hit].astype(np.int64), offset[hit].astype(np.int64)


def kept_pieces(text: bytes, runs: np.ndarray) -> tuple[bytes, int, int]:
    """(kept bytes, removed, spans) for runs (from, to) of string starts, in any order."""
    if not len(runs):
        return text, 0, 0
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    out, at, removed, spans, stop = [], 0, 0, 0, -1
    for begin, last in runs.tolist():
        end = last + LENGTH
        if begin > stop:
            if stop > 0:
                at = stop
            out.append(text[at:begin])
            spans += 1
            removed += end - begin
            stop = end
        elif end > stop:
            removed += end - stop
            stop = end
    out.append(text[stop:])
    return b"".join(out), removed, spans


def _remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """A shelf and the runs of its texts -> every row after removal."""
    keys, _ = _texts(left, right)
    number = {k: i for i, k in enumerate(keys)}
    copies = {(d, c) for d, c in zip(_column(right, "doc"), _column(right, "content")) if c is not None}
    runs = np.concatenate([np.empty((0, 3), dtype=np.uint32), *(np.frombuffer(x, dtype=np.uint32).reshape(-1, 3) for x in _column(right, "data") if x is not None)]).astype(np.int64)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    edge = np.searchsorted(runs[:, 0], np.arange(len(keys) + 1))
    out = []
    for doc, content, text in zip(_column(left, "doc"), _column(left, "content"), left.column("text").cast(pa.binary()).to_pylist()):
        text = text or b""
        own = number.get((doc, content))
        if own is not None:
            done = kept_pieces(text, runs[edge[own] : edge[own + 1], 1:])
        else:
            done = (b"", len(text), 1) if len(text) >= LENGTH and (doc, content) in copies else (text, 0, 0)
        out.append((doc, done[0], len(text), done[1], done[2]))
    doc, kept, size, removed, spans = zip(*out) if out else ((),) * 5
    return pa.table({"doc": pa.array(doc, pa.int64()), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: str = "content", hot: int = HOT, n_shelves: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """(doc, kept, n_bytes, n_removed, n_spans) for every row.  ``sample``: "content" or "cover"; ``n_shelves`` and
    ``n_buckets``: by the number of bytes, if not given; 4 and 8 for each shuffle partition, so that what falls to one is
    even, if there is work for so many."""
    spark = docs.sparkSession
    address = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).withColumn("content", address)
    sizes = materialise(rows.where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "content", F.octet_length("text").alias("size")), "substring-contents")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shelves = n_shelves or max(1, math.ceil(total / SHELF_BYTES), min(4 * tasks, total // LEAST_SHELF))
    name_bytes = total * (len(COVER) / COVER_PERIOD if sample == "cover" else 2 / (LENGTH - BLOCK + 2)) * 6
    n_buckets = n_buckets or max(1, math.ceil(name_bytes / BUCKET_BYTES), min(8 * tasks, int(name_bytes) // LEAST_BUCKET))

    shelf = F.pmod(F.xxhash64("doc", "content"), F.lit(n_shelves)).cast("int").alias("shelf")
    # Written down, so that the join has an exchange on either side and a content of very many copies can be split.
    firsts = materialise(sizes.groupBy("content").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("content", "first"), "substring-firsts")
    copies = materialise(sizes.join(firsts, "content").where("doc > first").select(shelf, "doc", "content"), "substring-copies")
    copies = copies.select("shelf", F.lit(-1).alias("bucket"), "doc", "content", F.lit(None).cast("binary").alias("data"))
    say = lambda told: copies.unionByName(told.withColumns({"doc": F.lit(None).cast("bigint"), "content": F.lit(None).cast("binary")}))
    texts = rows.select("doc", "text", "content", shelf)
    meet = lambda told, run, kind: texts.groupBy("shelf").cogroup(told.groupBy("shelf")).applyInArrow(run, kind)

    named = meet(copies, _names(n_buckets, sample), _NAMES)
    repeated = named.groupBy("bucket").applyInArrow(_repeated(hot), _TOLD)
    contexts = meet(say(repeated), _contexts(n_buckets, sample), _CONTEXTS)
    places = contexts.groupBy("bucket").applyInArrow(_places(sample), _TOLD)
    return meet(say(places), _remove, "doc bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
