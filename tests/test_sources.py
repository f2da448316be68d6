"""Sources and sinks over small files."""

from __future__ import annotations

import json

import pytest

from tessera.sources import catalog as C


def test_catalog(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"file": "a.py", "name": "f", "line": 3, "params": [{"name": "x", "type": "int"}]}, {"file": "b.py", "name": "g", "line": 1}]))
    rows = {r["item_key"]: r for r in C.read_catalog(spark, f"file://{tmp_path}/c.json").collect()}
    assert set(rows) == {"a.py:3", "b.py:1"} and rows["a.py:3"]["params"][0]["name"] == "x" and rows["b.py:1"]["params"] is None
    (tmp_path / "d.json").write_text('{"file": "a.py"}')
    with pytest.raises(ValueError):
        C.read_catalog(spark, f"file://{tmp_path}/d.json")


def test_jsonl(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": 1, "s": "a"}\n\n{"id": 2\nnot json\n{"id": 3}\n')
    good, bad = C.read_jsonl(spark, f"file://{tmp_path}/l.jsonl", "id bigint, s string")
    assert sorted(r["id"] for r in good.collect()) == [1, 3] and bad.count() == 2


def test_tree(spark, tmp_path):
    for name in ("src/a.py", "src/b.ts", "tests/c.py", "src/d.test.ts", "src/e.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = {r["path"].rsplit("/", 1)[1]: r["language"] for r in C.read_tree(spark, f"file://{tmp_path}").collect()}
    assert found == {"a.py": "python", "b.ts": "typescript"}


def test_append_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([("a", "final"), ("b", "partial"), (None, "final"), ("a", "final")], "task_id string, status string")
    for _ in range(2):
        C.append_once(rows, path, "task_id", "status")
    assert [r["task_id"] for r in spark.read.parquet(path).collect()] == ["a"]


def test_documents(spark):
    assert {r["key"]: r["value"] for r in C.read_documents(spark, '{"a": 1, "b": [2]}').collect()} == {"a": "1", "b": "[2]"}
