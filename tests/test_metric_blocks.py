"""Rows near each other in their metrics: every pair, at any size of blocks and tiles, and no join of pairs for it."""

from __future__ import annotations

import itertools
import random

import pytest

from tessera.operators import metric_blocks as B
from tessera.operators import strategies as S
from tessera.plans.queries import QUERIES

COLUMNS = "id bigint, n bigint, " + ", ".join(f"{c} double" for c in S.METRICS)


@pytest.mark.parametrize(("seed", "block", "out", "tile"), [(1, 40, 5, 7), (2, 16_000, 1 << 16, 16), (3, 100, 1, 256)])
def test_blocks_equal_all_pairs(spark, monkeypatch, seed, block, out, tile):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "OUT", out)
    monkeypatch.setattr(S, "SPLIT", tile)
    rng, rows = random.Random(seed), []
    for k in range(200):
        values = [rng.choice([float(rng.randint(0, 9)), 10 ** rng.uniform(0, 4), None]) for _ in S.METRICS]
        if k % 2:
            values = [v if v is None else v * rng.choice([1, 1, 1.1, 1.3]) for v in rows[rng.randrange(len(rows))][2:]]
        rows.append((k, k % 4 + 1, *values))
    want = {}
    for p, q in itertools.combinations(rows, 2):
        gaps = [abs(x - y) / max(x, y, 1) for x, y in zip(p[2:], q[2:]) if x is not None and y is not None]
        if len(gaps) >= 3 and round(1 - sum(gaps) / len(gaps), 4) >= 0.9:
            want[p[0], q[0]] = (p[1], q[1], 1 - sum(gaps) / len(gaps))
    got = {(r["a"], r["b"]): (r["n_a"], r["n_b"], r["score"]) for r in S.metric_pairs(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got.keys() == want.keys() and len(want) > 30
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-4 for k in want)


def test_pairs_are_not_joined(spark):
    """Before, the pairs were joined out of cells and then twice more for the sizes of both sides."""
    plan = QUERIES["sim_05_metric_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_no_row_is_compared_with_none(spark):
    assert S.metric_pairs(spark.createDataFrame([], COLUMNS)).count() == 0
