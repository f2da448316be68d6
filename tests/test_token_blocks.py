"""Tokens in common, block against block: every pair at any size of blocks, and nothing shuffled for it."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import strategies as S
from tessera.operators import token_blocks as T


def texts(seed: int, n: int = 90) -> list[list[str]]:
    rng = random.Random(seed)
    often, rare = [f"o{k}" for k in range(12)], [f"r{k}" for k in range(120)]
    out = [rng.choices(often, k=rng.randint(0, 25)) + rng.choices(rare, k=rng.randint(0, 14)) + [f"u{k}"] * (k % 3) for k in range(n)]
    return out + [[w for w in t if rng.random() < 0.93] for t in out] + [[], ["o1"], ["o1"] * 5000, ["o1"] * 4900 + ["o2"]]


def runs(t: list[str], lengths) -> Counter:
    return Counter((k, *t[i : i + k]) for k in lengths for i in range(len(t) - k + 1))


def want(rows, kind: str, threshold: float, lengths):
    lists = [{k: runs(t, own) for k, t in rows} for own in lengths]
    out = {}
    for (a, _), (b, _) in itertools.combinations(rows, 2):
        shares = []
        for held in lists:
            p, q = held[a], held[b]
            c = len(p.keys() & q.keys())
            if kind == "cosine":
                norm = math.sqrt(sum(x * x for x in p.values()) * sum(x * x for x in q.values()))
                shares.append(sum(x * q[f] for f, x in p.items()) / norm if norm else 0.0)
            else:
                under = min(len(p), len(q)) if kind == "overlap" else len(p.keys() | q.keys())
                shares.append(c / under if under else 0.0)
        if sum(shares) >= len(shares) * threshold - 1e-12 and lists[0][a] and lists[0][b]:
            out[a, b] = tuple(shares)
    return out


@pytest.mark.parametrize(("seed", "kind", "threshold", "lengths", "columns"), [
    (1, "jaccard", 0.4, [(1,)], 2048), (2, "jaccard", 0.75, [(1,)], 3), (3, "overlap", 0.4, [(1,)], 0), (4, "cosine", 0.85, [(1,)], 2048), (5, "cosine", 0.5, [(3, 4, 5)], 5), (6, "screen", 0.4, [(3,), (5,)], 2048),
])
def test_blocks_equal_all_pairs(spark, monkeypatch, seed, kind, threshold, lengths, columns):
    for name, value in (("PART", 7), ("ROWS", 40), ("ENTRIES", 900), ("COLUMNS", columns), ("PRODUCTS", 50)):
        monkeypatch.setattr(T, name, value)
    rows = list(enumerate(texts(seed)))
    table = T.hashed_tokens(spark.createDataFrame(rows, "id bigint, w array<string>"), "w")
    found = T.common_pairs(table, kind, threshold, lengths)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["a"], r["b"]): tuple(r)[2 : 2 + len(lengths)] for r in found.collect()}
    all_ = want(rows, kind, threshold, lengths)
    assert got.keys() == all_.keys() and len(all_) > 20
    assert all(got[k] == pytest.approx(all_[k], abs=1e-12) for k in all_)


def test_sums_that_single_precision_cannot_hold(spark):
    table = T.hashed_tokens(spark.createDataFrame([(1, ["x"] * 5001 + ["y"]), (2, ["x"] * 5000 + ["y"] * 3)], "id bigint, w array<string>"), "w")
    assert T.common_pairs(table, "cosine", 0.5).first()["score"] == (5001 * 5000 + 3) / math.sqrt((5001**2 + 1) * (5000**2 + 9))


def test_strategies_send_no_features(spark):
    """Before, candidates met by a join on the features that two rows share."""
    catalog = spark.createDataFrame([(k, t) for k, t in enumerate(texts(7))], "id bigint, token_sequence array<string>").withColumn("unguarded", F.lit(True))
    for strategy in (S.winnowing, S.bag_of_ast, S.code_embedding, S.screened, S.word_pairs):
        assert "Join" not in strategy(catalog)._jdf.queryExecution().optimizedPlan().toString()
