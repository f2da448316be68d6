"""Cosines block against block: every pair, at any size of blocks, and no row for a word that two texts share."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import cosine_blocks as B
from tessera.operators import strategies as S


def texts(seed: int, n: int = 120) -> list[list[str]]:
    """Frequent words that nearly all texts have, rare ones, words of one text, and near copies."""
    rng = random.Random(seed)
    often, rare = [f"o{k}" for k in range(12)], [f"r{k}" for k in range(150)]
    out = [rng.choices(often, k=rng.randint(0, 20)) + rng.choices(rare, k=rng.randint(0, 12)) + [f"u{k}"] * (k % 3) for k in range(n)]
    return out + [[w for w in t if rng.random() < 0.9] for t in out[: n // 3]] + [[], ["o1"]]


@pytest.mark.parametrize(("seed", "threshold", "weigh", "columns"), [(1, 0.5, True, 2048), (2, 0.85, False, 4), (3, 0.5, True, 0), (4, 0.3, False, 2048)])
def test_blocks_equal_all_pairs(spark, monkeypatch, seed, threshold, weigh, columns):
    monkeypatch.setattr(B, "PART", 7)
    monkeypatch.setattr(B, "BLOCK", 30)
    monkeypatch.setattr(B, "COLUMNS", columns)
    rows = [(k, 1 + k % 3, t) for k, t in enumerate(texts(seed))]
    catalog = spark.createDataFrame(rows, "id bigint, copies int, token_sequence array<string>")
    total, df = float(sum(r[1] for r in rows)), Counter()
    for _, copies, t in rows:
        df.update(dict.fromkeys(t, copies))
    idf = {w: math.log(total / d) if weigh else 1.0 for w, d in df.items()}
    found = B.cosine_pairs(catalog, "token_sequence", threshold, total if weigh else None, 0.5 if weigh else 0.0)
    got = {(r["a"], r["b"]): r["score"] for r in found.collect()}
    want = {}
    for (a, _, s), (b, _, t) in itertools.combinations(rows, 2):
        x, y = ({w: c * idf[w] for w, c in Counter(v).items()} for v in (s, t))
        p, q = (sum(v * v for v in z.values()) for z in (x, y))
        score = sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(p * q) if p and q else 0.0
        if round(score, 12) >= threshold and (not weigh or round(sum(idf[w] for w in x.keys() & y.keys()), 12) >= 0.5):
            want[a, b] = score
    assert got.keys() == want.keys() and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_products_are_made_some_at_a_time(monkeypatch):
    monkeypatch.setattr(B, "PRODUCTS", 5)
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 3, (20, 40)).astype(float)
    rest = [[{"f": int(f), "c": float(v), "w": 1.0} for f, v in enumerate(row) if v] for row in dense]
    kind = pa.list_(pa.struct([("f", pa.int64()), ("c", pa.float64()), ("w", pa.float64())]))
    empty = pa.array([[]] * 20, pa.list_(pa.int32()))
    part = B._Part(pa.table({"id": range(20), "square": (dense**2).sum(axis=1), "k": empty, "kc": empty, "rest": pa.array(rest, kind)}), np.empty(0))
    assert (part.products(part, lambda p, i, q, j: p.x[i] * q.x[j]) == dense @ dense.T).all()


def test_strategies_do_not_join_on_words(spark):
    """Before, each pair of texts was a row for every word that both have."""
    catalog = spark.createDataFrame([(k, f"s/{k}", t) for k, t in enumerate(texts(5))], "id bigint, file string, token_sequence array<string>").withColumn("unguarded", S.F.lit(True))
    for strategy in (S.tfidf_index, S.bag_of_ast):
        assert "Join" not in strategy(catalog)._jdf.queryExecution().optimizedPlan().toString()
