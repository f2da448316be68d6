"""Which of many terms stand in each text: one automaton of all terms runs over every text once.

A text costs its length, however many terms there are.  Terms are sent to all tasks in shards of at most ``SHARD_BYTES``, each a pass
over the texts, so nothing that grows without bound is broadcast.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 8 << 20


def terms_in(texts: DataFrame, terms: DataFrame, id: str = "id", text: str = "text", term: str = "term") -> DataFrame:
    """(id, term) of every distinct term that is a substring of a text; empty terms and null texts match nothing."""
    spark = texts.sparkSession
    named = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    (size,) = named.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()
    shards = max(1, -(-size // SHARD_BYTES))
    kind = texts.schema[id].dataType.simpleString()
    out = spark.createDataFrame([], f"id {kind}, term string")
    for shard in range(shards if size else 0):
        words = named.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == shard).toArrow().column(0).to_pylist()
        found = _scan(texts.select(F.col(id).alias("id"), F.col(text).alias("text")), spark.sparkContext.broadcast(words), f"id {kind}, term string")
        out = found if shard == 0 else out.unionByName(found)
    return out


def _scan(texts: DataFrame, words, schema: str) -> DataFrame:
    def run(batches):
        automaton = ahocorasick.Automaton()
        for w in words.value:
            automaton.add_word(w, w)
        if words.value:
            automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted({w for _, w in automaton.iter(t)}) if t and words.value else []
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(found, pa.string())], ["id", "term"])

    return texts.mapInArrow(run, schema)
