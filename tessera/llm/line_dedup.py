"""Line dedup over overlapping windows of three consecutive lines.

Each window is addressed by 128 bits over its three lines.  A window's first occurrence is the least (doc_id,
position); the lines that later occurrences cover are merged and removed.  A document's own repeats are settled
inside its row, so only (window, document) pairs travel: once to find windows of several documents, with sums before
the shuffle, and once to mark the documents that come later, in a join that Spark can split at a hot window.

Defined results: a null text stays null; texts of fewer than three lines and windows without a word have no
occurrence; rows without doc_id stay as they are; rows that share a doc_id are one document's versions, which do not
count as earlier for each other; a long text is one row of one task, read line by line; an empty table gives an empty
result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, slices, unused, utf8

WINDOW = 3


def window_keys(lines: list[bytes]) -> list[bytes | None]:
    """The key of the window that starts at each line; None for one without a word."""
    hashes = [hashlib.blake2b(line, digest_size=16).digest() for line in lines]
    worded = [bool(line.split()) for line in lines]
    return [hashlib.blake2b(b"".join(hashes[i : i + WINDOW]), digest_size=16).digest() if any(worded[i : i + WINDOW]) else None for i in range(len(lines) - WINDOW + 1)]


def cut(text: bytes, later: set[bytes]) -> tuple[bytes, int, int]:
    """(text, lines, lines removed) without the lines under windows in ``later`` or under repeats within the text."""
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    gone: set[int] = set()
    for i, key in enumerate(window_keys(lines)):
        if key is None:
            continue
        if key in later or key in seen:
            gone.update(range(i, i + WINDOW))
        seen.add(key)
    kept = [line for i, line in enumerate(lines) if i not in gone] if gone else lines
    return b"\n".join(kept), len(lines), len(gone)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        docs, keys = [], []
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch)):
            if text is None:
                continue
            own = dict.fromkeys(k for k in window_keys(text.split(b"\n")) if k is not None)
            docs += [doc] * len(own)
            keys += own
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary())], names=["doc", "window"])


def _cut(text: pa.Array, later: pa.Array, known: pa.Array) -> pa.Array:
    texts, lines, removed = [], [], []
    for body, keys, named in zip(text.cast(pa.binary()).to_pylist(), later.to_pylist(), known.to_pylist()):
        if body is None:
            done = (None, 0, 0)
        elif not named:
            done = (body, body.count(b"\n") + 1, 0)
        else:
            done = cut(body, set(keys or ()))
        texts.append(done[0])
        lines.append(done[1])
        removed.append(done[2])
    return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=["text", "n_lines", "n_removed"])


def later_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, later): for each document with any, the windows whose first occurrence is in a smaller doc_id."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    occurrences = materialise(rows.mapInArrow(_occurrences, "doc bigint, window binary"), "line-windows")
    shared = occurrences.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("window", "first")
    return occurrences.join(shared, "window").where("doc > first").groupBy("doc").agg(F.collect_set("window").alias("later"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str | None = None) -> DataFrame:
    """The columns of ``docs``, then the struct (text, n_lines, n_removed) after removal, as ``out`` (``_l`` if not given)."""
    own, windows, out = unused(docs, "doc"), unused(docs, "later"), out or "_l"
    later = later_windows(docs, doc_id, text).select(F.col("doc").alias(own), F.col("later").alias(windows))
    joined = docs.join(later, F.col(f"`{doc_id}`").cast("bigint") == F.col(own), "left")
    known = F.col(f"`{doc_id}`").cast("bigint").isNotNull()
    done = F.arrow_udf(_cut, "struct<text: string, n_lines: bigint, n_removed: bigint>")(F.col(f"`{text}`"), F.col(windows), known)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], done.alias(out))


def edit_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the text after removal, and n_chars where there is such a column."""
    name = unused(docs, "l")
    out = dedup(docs, doc_id, text, name)
    fresh = {text: F.col(f"{name}.text")} | ({n_chars: F.length(f"{name}.text").cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return out.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
