"""Token counts against the library that the vocabulary is for."""

from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from tessera.llm import token_counts as T
from tessera.llm.q_tokens import MOST, VOCABULARY, query


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def merges():
    return T.Merges(VOCABULARY)


def odd_texts() -> list[str]:
    rng = random.Random(1)
    out = [
        "<|endoftext|>x<|startoftext|><|endoftext|>", "<|endoftext|", " <|STARTOFTEXT|> ΑΣ ΣΑΣ", "I'll WE'VE 's''s 're 'Tis don't", "é ́x ñ", "\x1c\x1d a\x85b\xa0c　d​e", "",
        "   \n", "ab" * 3000, "aaaaa" * 1000, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(9000)), "".join(rng.choice("!?.,-#") for _ in range(5000)),
    ]
    return out + ["".join(rng.choice("abcdefghiklmnoprstuvwy   '.,!1234é中ΣİǅḰﬁ") for _ in range(rng.randrange(1, 900))) for _ in range(150)]


def test_equals_the_library(library, merges):
    texts = odd_texts()
    assert T.Counter(merges).counts(texts) == library(texts)


@pytest.mark.parametrize("long", [4, 10**9])
def test_ragged_and_linked_arrays_agree(monkeypatch, library, merges, long):
    monkeypatch.setattr(T, "LONG", long)
    texts = [t.replace(" ", "") for t in odd_texts()]
    assert T.Counter(merges).counts(texts) == library(texts)


def test_one_occurrence_at_a_time_where_ranks_could_fall(monkeypatch, library, merges):
    monkeypatch.setattr(merges, "together", merges.together & False)
    for long in (4, 10**9):
        monkeypatch.setattr(T, "LONG", long)
        texts = odd_texts()[:60]
        assert T.Counter(merges).counts(texts) == library(texts)


def test_pieces_and_memo_change_nothing(monkeypatch, library, merges):
    monkeypatch.setattr(T, "PIECE", 50)
    monkeypatch.setattr(T, "MEMO", 20)
    texts = odd_texts()
    assert T.Counter(merges).counts(texts) == library(texts)


def test_a_long_endless_word_takes_linear_time(library, merges):
    rng = random.Random(2)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200_000))
    assert T.Counter(merges).counts([text]) == library([text])


def test_letters_of_each_plane(library, merges):
    """One text a code point: white space, cases and classes are the library's (but for letters newer than its tables)."""
    texts = ["a" + chr(k) + "b " + chr(k) + "A" for k in range(0x3000)]
    assert T.Counter(merges).counts(texts) == library(texts)


def test_query_over_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = dict(zip(texts, library(list(texts.values()))))
    rows = query(spark, folder).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and len(rows) == len(texts)
    assert all(r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > MOST) for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (None, "two words", "x"), (3, "two words", "x")] + [(3, "two words", "x")], "doc_id bigint, text string, n_tokens string")
    got = sorted((str(r["doc"]), r["n_bytes"], r["n_tokens"]) for r in T.count(docs, VOCABULARY).collect())
    assert got == [("1", 0, 0), ("2", 0, 0), ("3", 2, 0), ("3", 9, 2), ("3", 9, 2), ("None", 9, 2)]
    assert T.count(docs.where("doc_id > 9"), VOCABULARY).collect() == []
