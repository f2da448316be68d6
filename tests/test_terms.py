"""Many terms in one pass, against looking for each, and catalogs written and read in parts."""

from __future__ import annotations

import random

import pytest

from tessera.operators import terms as T
from tessera.operators.rules_text import secrets_near_logs
from tessera.sources import catalog as C


@pytest.mark.parametrize("shard", [8 << 20, 60])
def test_terms_equal_looking_for_each(spark, monkeypatch, shard):
    monkeypatch.setattr(T, "SHARD_BYTES", shard)
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["", None]
    texts = [(k, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 40)))) for k in range(80)] + [(99, None), (5, "ab")]
    got = sorted((r["id"], r["term"]) for r in T.terms_in(spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame([(w,) for w in words], "term string")).collect())
    assert got == sorted((k, w) for k, t in texts for w in {w for w in words if w} if t and w in t)


def test_no_terms_and_no_texts(spark):
    texts, terms = spark.createDataFrame([(1, "a")], "id int, text string"), spark.createDataFrame([("a",)], "term string")
    assert T.terms_in(texts, terms.where("term > 'x'")).collect() == [] and T.terms_in(texts.where("id > 1"), terms).collect() == []
    assert T.terms_in(texts, terms).dtypes == [("id", "int"), ("term", "string")]


def test_band_join_of_lines_equals_all_pairs(spark):
    rng = random.Random(4)
    docs = [(f"d{k}", "\n".join(rng.choice(["token = 1", "print(x)", "", "x", "token = 2; print(y)"]) for _ in range(rng.randint(1, 60)))) for k in range(20)]
    for reach in (1, 4, 10):
        want = sorted((p, i, j) for p, t in docs for i, x in enumerate(t.split("\n"), 1) for j, y in enumerate(t.split("\n"), 1) if "token" in x and "print" in y and abs(i - j) <= reach)
        got = sorted((r["path"], r["secret"], r["log"]) for r in secrets_near_logs(spark.createDataFrame(docs, "path string, content string"), reach).collect())
        assert got == want


@pytest.mark.parametrize("parts", [1, 3])
def test_arrays_in_parts(spark, tmp_path, parts):
    rows = spark.range(50).selectExpr("concat('f', id, '.py') AS file", "concat('n,\"', id) AS name", "id AS line").repartition(parts)
    C.write_json_array(rows, f"file://{tmp_path}/c")
    back = C.read_catalog(spark, f"file://{tmp_path}/c")
    assert sorted((r["file"], r["name"], r["line"]) for r in back.collect()) == sorted((f"f{k}.py", f'n,"{k}', k) for k in range(50))
    C.write_json_array(rows.where("line > 99"), f"file://{tmp_path}/e")
    assert C.read_catalog(spark, f"file://{tmp_path}/e").collect() == []
