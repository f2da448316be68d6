"""The pipeline against a brute-force version, and every registered query over the smallest tables."""

from __future__ import annotations

import os
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import decontamination, sentencepiece_codec
from tessera.llm.q_pieces import MODEL_FILE
from tessera.llm.queries import ORACLES, QUERIES

from .test_text_operators import brute_groups

FOLDER = "/root/testdata/sf0.001"


def brute_pipeline(docs: dict[int, str | None], items: list[tuple[int, str]]) -> dict[int, list[int]]:
    kept = {}
    for doc, text in docs.items():
        words = (text or "").encode().split()
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i : i + 3])] > 1}
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words):
            kept[doc] = text
    first: dict[tuple, tuple] = {}
    for doc in sorted(kept):
        lines = kept[doc].split("\n")
        for i in range(len(lines) - 2):
            first.setdefault(tuple(lines[i : i + 3]), (doc, i))
    for doc in kept:
        lines = kept[doc].split("\n")
        gone = {i + k for i in range(len(lines) - 2) for k in range(3) if first[tuple(lines[i : i + 3])] != (doc, i) and "".join(lines[i : i + 3]).strip()}
        kept[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    order = sorted(kept)
    component = brute_groups([kept[d] for d in order], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    kept = {d: kept[d] for k, d in enumerate(order) if component[k] == k}
    out = {}
    codec = sentencepiece_codec.Codec(MODEL_FILE)
    for doc, text in kept.items():
        words = decontamination.words_of(text)
        leaked = False
        for _, item in items:
            want = decontamination.words_of(item)
            whole = {tuple(want[i : i + 3]) for i in range(len(want) - 2)}
            leaked |= bool(whole) and len(whole & {tuple(words[i : i + 3]) for i in range(len(words) - 2)}) / len(whole) >= 0.6
        if not leaked:
            out[doc] = codec.encode(text)
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, words(18) + ". " + words(5)) for k in range(12)]
    shared = [words(12) for _ in range(3)]
    docs: dict[int, str | None] = {}
    for k in range(90):
        lines = [words(rng.randint(5, 25)) for _ in range(rng.randint(3, 9))]
        if k % 5 == 0:
            lines[1:1] = shared
        if k % 13 == 0:
            lines.append(items[k % 12][1])
        docs[k] = "\n".join(lines)
        if k % 6 == 5:
            copy = docs[k - 1].split(" ")
            copy[len(copy) // 2] = "zzz"
            docs[k] = " ".join(copy)
        if k % 17 == 3:
            docs[k] = docs[k - 2]
    docs |= {200: None, 201: "", 202: "word " * 80, 203: "short text"}
    spark.createDataFrame([(d, t, "en", f"s{d % 4}", len(t or "")) for d, t in docs.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == brute_pipeline(docs, items)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    rows = got.collect()
    assert rows or name.startswith("op2_")
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(str([r[c] for c in columns]) for r in rows) == sorted(str(list(r)) for r in want.fetchall())


def test_languages_on_held_out_texts(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.98
