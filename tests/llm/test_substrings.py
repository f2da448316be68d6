"""Substring removal against brute force: both samples, hot names dealt out by strings, repeated ids, long texts."""

from __future__ import annotations

import random

import pytest

from tessera.llm.substring_dedup import remove_repeats

from .test_text_operators import brute_spans, corpus


def answers(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((r["doc"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(docs, **how).collect())


@pytest.mark.parametrize("how", [{}, {"hot": 1}, {"hot": 3, "n_shelves": 1, "n_buckets": 1}, {"sample": "cover"}, {"sample": "cover", "hot": 2, "n_shelves": 3}])
def test_equals_brute_force(spark, how):
    texts = corpus(seed=11, n=90)
    rng = random.Random(2)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))
    texts += [f"{rng.random()} {passage} {rng.random()}" for _ in range(40)]
    texts += [passage * 3, "ab" * 400, "ab" * 399]
    want = brute_spans({k: (t or "").encode() for k, t in enumerate(texts)})
    assert answers(spark, list(enumerate(texts)), **how) == [(k, *want[k]) for k in range(len(texts))]


def test_versions_of_one_document_are_judged_by_their_own_text(spark):
    a, b, c = ("".join(random.Random(k).choice("abcdefgh ") for _ in range(84)) for k in range(3))
    got = answers(spark, [(1, a), (5, a), (5, b), (5, b + c), (7, b), (7, b)])
    assert got == sorted([(1, a.encode(), 84, 0, 0), (5, b"", 84, 84, 1), (5, b.encode(), 84, 0, 0), (5, (b + c).encode(), 168, 0, 0), (7, b"", 84, 84, 1), (7, b"", 84, 84, 1)])


def test_long_texts(spark):
    rng = random.Random(9)
    words = [str(rng.random()) for _ in range(260_000)]
    long = " ".join(words)
    assert len(long) > 4_500_000
    got = answers(spark, [(1, words[7] + words[9] * 4), (2, long), (3, "x" + long[1_000_000:1_000_200] + "y"), (4, "z" * 5_000_000)])
    assert [(g[0], g[2], g[3], g[4]) for g in got] == [(1, len(words[7] + words[9] * 4), 0, 0), (2, len(long), 0, 0), (3, 202, 200, 1), (4, 5_000_000, 0, 0)]


def test_null_rows(spark):
    text = "y" * 60
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    docs = spark.createDataFrame([(None, text), (1, text), (None, None), (2, None), (3, text)], "doc_id bigint, text string")
    got = sorted((r["doc"] or 0, bytes(r["kept"]), r["n_removed"]) for r in remove_repeats(docs).collect())
    assert got == [(0, b"", 0), (0, text.encode(), 0), (1, text.encode(), 0), (2, b"", 0), (3, b"", 60)]
