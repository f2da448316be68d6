"""What the training-data operators share: scratch tables, batches of bounded size, hashing."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds decoded at one time (one text alone may be longer).
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage of ``df`` with a written table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return next(c for c in (f"{name}_{k}" for k in range(len(taken) + 1)) if c.lower() not in taken)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices with about ``SLICE_BYTES`` of text each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array([0 if n is None else n for n in pc.binary_length(column).to_pylist()], dtype=np.int64)
        part = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def utf8(batch: pa.RecordBatch, text: str = "text") -> list[bytes | None]:
    """The texts of a batch as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of ``Among``: 8 MB, and so much at most goes to the driver and to each task.
SEEN_BITS = 1 << 26
_WORD = 32768


class Among:
    """A test of ids that is true for all of a table and few others, so that rows with long texts need not be sent to be joined.

    Ids are kept as bits at their hash.  The bits do not grow with the table: a fuller one passes more ids, and no less than all of its own.
    """

    def __init__(self, table: DataFrame, column: str) -> None:
        words = table.where(f"`{column}` IS NOT NULL").select(self.place(F.col(f"`{column}`")).alias("p")).groupBy(F.expr(f"p div {_WORD}").alias("w"))
        found = words.agg(F.bitmap_construct_agg(F.expr(f"p % {_WORD}")).alias("bits")).toArrow()
        bits = np.zeros(SEEN_BITS // 8, dtype=np.uint8)
        for w, own in zip(found.column("w").to_pylist(), found.column("bits").to_pylist()):
            bits[w * _WORD // 8 : w * _WORD // 8 + len(own)] = np.frombuffer(own, dtype=np.uint8)
        self.held = table.sparkSession.sparkContext.broadcast(bits.tobytes())

    @staticmethod
    def place(ids: Column) -> Column:
        return F.pmod(F.xxhash64(ids), F.lit(SEEN_BITS))

    def test(self):
        """A function of a column of places, for tasks."""
        held = self.held

        def run(places: pa.Array) -> pa.Array:
            at = places.to_numpy(zero_copy_only=False).astype(np.int64)
            return pa.array((np.frombuffer(held.value, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

        return run

    def __call__(self, ids: Column) -> Column:
        """False for a null id."""
        return ids.isNotNull() & F.arrow_udf(self.test(), "boolean")(self.place(ids))


class WordHashes(dict):
    """A bounded memo of 64-bit word hashes; it is emptied when full, which changes no result."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingles(words: list[bytes], width: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words are one shingle, none are none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(width, len(words))
    value = mix64(hashes[: len(hashes) - span + 1] + np.uint64(span))
    for k in range(1, span):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - span + 1 + k])
    return np.unique(value)
