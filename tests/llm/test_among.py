"""Texts are not sent to be told which documents are meant."""

from __future__ import annotations

from tessera.llm import common, near_dedup


def test_ids_of_a_table_and_few_others(spark, monkeypatch):
    ids = spark.range(-3000, 3000).select((common.F.col("id") * 977).alias("doc"))
    seen = common.Among(ids.where("doc % 2 = 0"), "doc")
    passed = {r["doc"] for r in ids.where(seen(common.F.col("doc"))).collect()}
    even = {977 * k for k in range(-3000, 3000, 2)}
    assert even <= passed and len(passed) < 3020
    assert spark.sql("SELECT cast(NULL AS bigint) AS doc").where(seen(common.F.col("doc"))).count() == 0
    monkeypatch.setattr(common, "SEEN_BITS", 1 << 15)
    assert {r["doc"] for r in ids.where(common.Among(ids, "doc")(common.F.col("doc"))).collect()} == {977 * k for k in range(-3000, 3000)}


def test_only_documents_that_go_are_sent(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:59])), (3, "another text"), (None, " ".join(words)), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = near_dedup.filter_documents(docs)
    assert sorted(out.collect(), key=str) == sorted((docs.where("doc_id IS NULL OR doc_id <> 2")).collect(), key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Join") == 1
