"""Every plan against DuckDB on the smallest tables, plan shapes, and hand-computed cases."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.functions import names
from tessera.operators import strategies as S
from tessera.operators import udf_operators as U
from tessera.plans.queries import ORACLES, QUERIES
from . import samples

from .corpus import generated

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def plain(rows) -> list:
    def one(x):
        return None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(str([one(x) for x in row]) for row in rows)


def checked(got):
    """No plan pairs all rows with all."""
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    return got


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    got = checked(QUERIES[name](spark, FOLDER))
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want.fetchall())


#: Queries over one fused table; ``test_clones`` holds what they share against brute force, so one of them is run here.
FUSED = {"sim_14_fusion", "sim_15_clone_type", "sim_16_recommendation", "sim_17_summary", "sim_18_evaluate", "flt_03_suppression", "ord_01_ranked_pairs", "jn_09_metadata_lookup"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - FUSED | {"sim_18_evaluate"}))
def test_others_run(spark, name):
    assert checked(QUERIES[name](spark, FOLDER)).collect() is not None


def test_names_and_signatures():
    assert names.name_score("getUser", "fetchUser") == pytest.approx(0.3 * 2 * 6 / 16 + 0.4 / 3 + 0.2 * 0.3)
    assert names.name_score("fmtDate", "formatDate") == pytest.approx(0.3 * 14 / 17 + 0.4 / 3 + 0.1 * 0.2)
    empty = {"params": [], "return_type": None}
    assert S.signature_score(empty, empty) == pytest.approx(0.36)
    assert names.normal_type("Optional[int]") == "" and names.normal_type("string | null") == "string" and names.normal_type("") == "any"


@pytest.mark.parametrize(
    ("found", "confidence", "effective"),
    [
        ({"token_clone": 1.0}, "HIGH", 1), ({"token_clone": 0.9}, "MEDIUM", 1), ({"bag_of_ast": 0.9, "pdg_semantic": 0.9, "winnowing": 0.9}, "HIGH", 2), ({"signature_match": 0.75}, "LOW", 1),
        ({"fuzzy_name": 0.9, "signature_match": 0.9}, "LOW", 2), ({"metric_similarity": 0.3}, None, 1), ({"llm_semantic": 0.95}, "MEDIUM", 1), ({"odd": 0.5, "tfidf_index": 0.5, "token_clone": 0.9}, "HIGH", 3),
    ],
)
def test_fusion_by_hand(spark, found, confidence, effective):
    rows = [(1, 2, name, score, 2 if name == "token_clone" else None) for name, score in found.items()]
    got = [(r["confidence"], r["effective"]) for r in S.fuse(spark.createDataFrame(rows, "a bigint, b bigint, strategy string, score double, clone_type int")).collect()]
    assert got == ([(confidence, effective)] if confidence else [])


def test_strategies_on_a_larger_catalog(spark):
    """Prefix filters lose no pair: 120 functions over few tokens, every pair by plain reading."""
    rng = random.Random(6)
    base = [[rng.choice("ABCDEFGHIJKL") for _ in range(rng.randint(8, 30))] for _ in range(30)]
    sequences = []
    for own in base:
        for _ in range(4):
            copy = [t if rng.random() < 0.9 else rng.choice("ABCDEFGHIJKLXYZ") for t in own]
            sequences.append(copy[: rng.randint(max(1, len(copy) - 4), len(copy))])
    rows = [(k, f"f{k}", f"n{k}", None, 1, None, None, None, None, None, None, s) for k, s in enumerate(sequences)]
    catalog = spark.createDataFrame(rows, samples.CATALOG)

    def grams(s, k):
        return [tuple(s[i : i + k]) for i in range(len(s) - k + 1)]

    def cosine(p, q):
        p, q = Counter(p), Counter(q)
        return sum(p[t] * q[t] for t in p) / math.sqrt(sum(x * x for x in p.values()) * sum(x * x for x in q.values())) if p and q else 0.0

    def jaccard(p, q):
        return len(set(p) & set(q)) / len(set(p) | set(q)) if p or q else 0.0

    def runs(s):
        return [g for k in (3, 4, 5) for g in grams(s, k)]

    checks = {
        "bag_of_ast": lambda p, q: cosine(p, q) * (round(cosine(p, q), 12) >= 0.85), "code_embedding": lambda p, q: cosine(runs(p), runs(q)) * (round(cosine(runs(p), runs(q)), 12) >= 0.5),
        "lsh_ast": lambda p, q: jaccard(p, q) * (jaccard(p, q) >= 0.75 and min(len(set(p)), len(set(q))) >= 5),
    }
    for name, score in checks.items():
        want = {(a, b): score(sequences[a], sequences[b]) for a in range(len(rows)) for b in range(a + 1, len(rows)) if score(sequences[a], sequences[b])}
        got = {(r["a"], r["b"]): r["score"] for r in S.STRATEGIES[name](catalog).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want), name
        assert len(want) > 50


def test_generated_corpus_is_found(spark):
    """Clones of types 1 to 3 of the generator are reported at MEDIUM or better, decoys are not clones of each other."""
    catalog, truth = generated(spark, seed=42)
    merged = S.fuse(S.signals(catalog, samples.groups(spark).where("grp < 0")))
    got = {r["kind"]: r for r in S.evaluate(merged, truth).where("floor = 'MEDIUM'").collect()}
    assert got["1"]["recall"] == got["2"]["recall"] == 1.0 and got["3"]["recall"] >= 0.8


def lcs_table(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_lcs(a, b):
    assert names.lcs_length(a, b) == lcs_table(a, b)


def test_strict_json():
    assert U.strict_json('{"b": 1, "a": [2]}') == (True, None, '{"a":[2],"b":1}')
    assert U.strict_json('{"a": 1, "a": 2}')[1] == "duplicate"
    assert U.strict_json("[[[[[[[[[1]]]]]]]]]")[1] == "depth"
    assert U.strict_json("NaN")[1] == "number"
    assert U.strict_json(None)[1] == "length"
    assert U.strict_json("{")[1] == "syntax"


def test_json_subset():
    assert U.is_subset({"a": {"b": 1}}, {"a": {"b": 1, "c": 2}, "d": 3})
    assert not U.is_subset({"a": [1]}, {"a": [1, 2]})
    assert not U.is_subset({"a": 1}, {"a": True})


def test_python_functions():
    source = "def f(a, b=1):\n    'd'\n    return a and b\n\nclass C:\n    def _g(self):\n        for x in self: pass\n"
    found = {r[1]: r for r in U.functions_of("m.py", source)}
    assert found["f"][4:8] == (2, 2, "d", "public") and found["_g"][5:8] == (2, None, "private")
    assert list(U.functions_of("bad.py", "def (")) == []
    same = next(U.functions_of("n.py", "def f(x, y=1):\n    'd'\n    return x and y\n"))
    assert same[8] == found["f"][8]


def test_report_is_whole(spark):
    """The registered report has its head, its totals and its clone types, not only the lists of pairs."""
    got = {r["section"] for r in QUERIES["snk_04_report"](spark, FOLDER).select("section").distinct().collect()}
    assert {0, 1, 2, 3, 4, 10, 11, 20, 30} <= got
