"""Hard negatives against all scores by plain reading."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessera.llm import hard_negatives as H
from tessera.llm.q_negatives import ORACLE, query

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows: list[tuple]) -> list[tuple]:
    kept = [(i, [math.floor(256 * float(x)) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, x, y in kept:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, label) for i, v, label in kept if i != a and len(v) == len(x))
        for s, p, _ in [t for t in scored if t[2] == y][:5]:
            band = [(n, i) for n, i, label in scored if label != y and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(band, 1)]
    return sorted(out)


def vectors(seed: int, n: int, size: int) -> list[tuple]:
    """Clusters, exact copies, ties, zero and odd vectors, nulls and components that are no numbers."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(size)] for _ in range(6)]
    rows = []
    for k in range(n):
        v = [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]
        if k % 3 == 0:
            v = [0.25] * size
        rows.append((k, v, rng.randrange(10)))
    return rows + [
        (n + 100, [0.0] * size, 1), (n + 1, [-0.25] * size, 1), (n + 2, None, 1), (n + 3, [0.1] * size, None), (n + 4, [0.1] * (size - 1) + [None], 3), (n + 5, [float("nan")] + [0.1] * (size - 1), 3),
        (n + 6, [float("inf")] * size, 3), (None, [0.3] * size, 2), (n + 7, [0.5, 0.5], 2), (n + 8, [0.5, 0.25], 3), (1_000_000, [0.5, 0.5], 2), (2_000_000, [], 1),
    ]


def found(spark, rows, monkeypatch, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/t/embeddings.parquet")
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in query(spark, f"{tmp_path}/t").collect())


@pytest.mark.parametrize(("seed", "sample", "tile", "block", "pivots", "chunk"), [(1, 4096, 2048, 16 << 20, 8, 256), (2, 40, 16, 1500, 3, 2), (3, 3, 7, 600, 8, 1), (4, 4096, 50, 16 << 20, 0, 3)])
def test_equals_all_scores(spark, monkeypatch, tmp_path, seed, sample, tile, block, pivots, chunk):
    """At any number of pivots and size of sample, tile, chunk and block of anchors."""
    for name, value in (("SAMPLE", sample), ("TILE", tile), ("BLOCK_BYTES", block), ("PIVOTS", pivots), ("CHUNK", chunk)):
        monkeypatch.setattr(H, name, value)
    rows = vectors(seed, 460, 12)
    assert found(spark, rows, monkeypatch, tmp_path) == plain(rows)


def test_large_components_are_exact(spark, monkeypatch, tmp_path):
    rng = random.Random(8)
    rows = [(k, [float(np.float32(rng.uniform(-200_000, 260_000))) for _ in range(6)], k % 4) for k in range(0, 400, 5)]
    assert found(spark, rows, monkeypatch, tmp_path) == plain(rows)


def test_empty_tables(spark, monkeypatch, tmp_path):
    assert found(spark, [], monkeypatch, tmp_path) == []


def test_no_anchors_no_label_partners(spark, monkeypatch, tmp_path):
    assert found(spark, [(1, [0.5], 1), (2, [0.5], 1), (100, [0.5], 9)], monkeypatch, tmp_path) == []


def test_brackets_hold_and_exclude():
    """No pair of a needed score is lost, and clustered rows are mostly not checked."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (8, 16))
    v = np.rint(centres[rng.integers(0, 8, 2000)] + rng.normal(0, 4, (2000, 16))).astype(np.int32)
    rows = H.Rows(np.arange(2000), np.zeros(2000), v)
    most = float(rows.norms.max())
    pivots = H.choose_pivots(rows, most)
    far = H.distances(v, np.sqrt(most - rows.norms), pivots).astype(np.float32)
    queries = H.Anchors(H.Rows(np.arange(50), np.zeros(50), v[:50]), None, pivots, most)
    exact = v[:50].astype(np.int64) @ v.T.astype(np.int64)
    need = np.partition(exact, -5, axis=1)[:, -5].astype(np.float64)
    brackets = queries._meets(queries.distances[:, None], far[None], far[None], need[:, None], np.full((50, 1), np.inf), np.arange(50))
    assert (brackets | (exact < need[:, None])).all() and brackets.mean() < 0.5
    a, r, s = queries.survivors(rows, far, need, np.full(50, np.inf), True)
    assert (exact[a, r] == s).all() and len(a) == (exact >= need[:, None]).sum()


def test_oracle_over_embeddings(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.execute(ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in query(spark, "/root/testdata/sf0.01").collect()) == sorted(want.fetchall())
