"""What grows with a table is neither in one task nor sent whole."""

from __future__ import annotations

import random

from tessera.operators import rules as R
from tessera.operators import rules_text as RT
from tessera.operators import strategies as S
from tessera.operators import udf_operators as U
from tessera.plans.queries import QUERIES


def test_sources_are_parsed_in_pieces(monkeypatch):
    """Cut anywhere, with strings and brackets over the cuts, a source gives what the whole of it gives; one bad piece, and it gives nothing."""
    rng = random.Random(3)
    parts = ["def f{k}(a, b=1):\n    'd'\n    return a and b\n", "@one\n@two(\n3)\nasync def g{k}(x):\n    return [y for y in x]\n", "T{k} = '''\ndef no(): pass\nclass No: pass\n'''\n", "class C{k}:\r\n    def _m(self):\r\n        if self: pass\r\n", "x{k} = 'a\\\ndef '\n", "try:\n    pass\nfinally:\n    def h{k}(): pass\n"]
    source = "".join(rng.choice(parts).replace("{k}", str(k)) for k in range(300))
    monkeypatch.setattr(U, "PIECE", 10**9)
    want = sorted(map(str, U.functions_of("m.py", source)))
    monkeypatch.setattr(U, "PIECE", 40)
    assert sorted(map(str, U.functions_of("m.py", source))) == want and len(want) > 150
    assert len(list(U.trees_of(source))) > 100
    assert list(U.functions_of("m.py", source + "def (\n")) == []


def test_smells_send_no_side_whole(spark):
    rows = [(f"src/{k}.ts", f"import {{ a, b }} from './m'\n\nexport const q{k} = a as any") for k in range(20)] + [("src/3.test.ts", "x")]
    found = RT.smells(spark.createDataFrame(rows, "path string, content string"))
    assert found.where("smell = 'missing_test'").count() == 19
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_pairs_need_no_window_over_a_confidence(spark):
    rows = [(k, k + 1, round(random.Random(k).random(), 2), k % 5, "LOW") for k in range(500)]
    got = S.ranked(spark.createDataFrame(rows, "a bigint, b bigint, composite double, n int, confidence string"))
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    order = sorted(rows, key=lambda r: (-r[2], -r[3], r[0], r[1]))
    assert {(r["a"], r["place"]) for r in got.collect()} == {(r[0], k) for k, r in enumerate(order, 1)}


def test_partitions_grow_with_the_records(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 10)
    assert R.by_key(spark.range(1000), "id").rdd.getNumPartitions() == 101


def test_screen_equals_all_pairs_and_copies_are_screened_once(spark, tmp_path):
    rng = random.Random(8)
    base = [[rng.choice("ABCDEFGH") for _ in range(rng.randint(3, 30))] for _ in range(15)]
    texts = [[w if rng.random() < 0.93 else rng.choice("XYZ") for w in own] for own in base for _ in range(3)] + base[:3] * 4
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def share(p, q, k):
        p, q = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (p, q))
        return len(p & q) / len(p | q) if p | q else 0.0

    want = {}
    for b, q in enumerate(texts):
        for a, p in enumerate(texts[:b]):
            j3, j5 = share(p, q, 3), share(p, q, 5)
            if j5 > 0 and j3 + j5 >= 0.8:
                want[a, b] = (round(j3, 4), round(j5, 4))
    got = QUERIES["jn_04_screen"](spark, str(tmp_path))
    assert {(r["a"], r["b"]): (r["j3"], r["j5"]) for r in got.collect()} == want and len(want) > 40
    catalog = spark.createDataFrame(list(enumerate(base)), "id bigint, token_sequence array<string>")
    assert {r["n"] for r in S.rarest_first(S.hashed(catalog, S.grams(3)), 0.4).collect()} <= set(range(1, 29))
