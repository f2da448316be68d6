"""Streams against their batch twins."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from tessera.plans.queries import QUERIES
from tessera.streaming import events as S

FOLDER = "/root/testdata/sf0.001"


def collect(frame, tmp_path, mode="append"):
    query = frame.writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table("out").collect()


def split(spark, tmp_path):
    """The events in three files, in order of time, the second one with a repeat of the first's rows."""
    table = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        table.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return table, f"{tmp_path}/in"


def test_exactly_once(spark, tmp_path):
    table, path = split(spark, tmp_path)
    table.where("event_id < 20").coalesce(1).write.mode("append").parquet(path)
    rows = collect(S.exactly_once(S.read_events(spark, path, table.schema, 10)), tmp_path)
    assert len(rows) == table.count()


def test_windows_equal_batch(spark, tmp_path):
    table, path = split(spark, tmp_path)
    rows = collect(S.failure_windows(S.read_events(spark, path, table.schema, 10)), tmp_path, "update")
    got = {(r["ws"], int(r["start"].timestamp() // 3600)): r["n"] for r in rows}
    want = {(r["ws"], r["hour"]): r["n"] for r in QUERIES["win_streaming_twin"](spark, FOLDER).collect()}
    assert got == want


def test_ingest(spark, tmp_path):
    table, path = split(spark, tmp_path)
    bad = table.limit(3).withColumn("event_type", F.lit("odd")).withColumn("event_id", F.col("event_id") + 100_000)
    bad.coalesce(1).write.mode("append").parquet(path)
    for _ in range(2):
        S.ingest(S.read_events(spark, path, table.schema), f"{tmp_path}/store", f"{tmp_path}/rejects", f"{tmp_path}/ck1").awaitTermination()
        shutil.rmtree(f"{tmp_path}/ck1")
    assert spark.read.parquet(f"{tmp_path}/store").count() == table.count()
    assert spark.read.parquet(f"{tmp_path}/rejects").where("event_type = 'odd'").count() == 6


def test_streaks_equal_batch(spark, tmp_path):
    table, path = split(spark, tmp_path)
    shutil.rmtree(path)
    table.coalesce(1).write.parquet(path)
    got = {(r["user_id"], r["event_id"]): r["streak"] for r in collect(S.failure_streaks(S.read_events(spark, path, table.schema)), tmp_path)}
    want = {(r["bead"], r["event_id"]): r["streak"] for r in QUERIES["win_16_failure_streak"](spark, FOLDER).collect()}
    assert got == want


def stream(spark, tmp_path, name, parts, schema):
    """A stream of one file a part, in order."""
    import os

    path = f"{tmp_path}/{name}"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        newest = max((f for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{path}/{f}"))
        os.utime(f"{path}/{newest}", (1_700_000_000 + 100 * k, 1_700_000_000 + 100 * k))
    return S.read_events(spark, path, spark.createDataFrame([], schema).schema)


def at(hours: float):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(hours=hours)


def test_late_corrections_of_two_streams(spark, tmp_path):
    """Outer rows come out after both watermarks, and the whole equals a left join of tables."""
    schema = "entry bigint, ts timestamp, amount double"
    booked = [[(k, at(k), 10.0 * k) for k in range(0, 6)], [(k, at(k), 10.0 * k) for k in range(6, 12)], [(999, at(900), 0.0)], [(1000, at(901), 0.0)]]
    corrected = [[(2, at(30), -1.0)], [(7, at(40), 1.0), (7, at(41), 2.0), (3, at(500), 9.0), (50, at(60), 1.0)], [(998, at(900), 0.0)], [(997, at(902), 0.0)]]
    got = collect(S.late_corrections(stream(spark, tmp_path, "l", booked, schema), stream(spark, tmp_path, "c", corrected, schema)), tmp_path)
    rows = sorted((r["entry"], r["change"]) for r in got if r["entry"] < 100 and r["change"] is not None)
    alone = sorted(r["entry"] for r in got if r["change"] is None and r["entry"] < 100)
    assert rows == [(2, -1.0), (7, 1.0), (7, 2.0)]
    assert alone == [k for k in range(12) if k not in (2, 7)]


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def failing(seed: int, n: int):
    import random

    rng = random.Random(seed)
    rows, hours = [], 0.0
    for k in range(n):
        hours += rng.choice([0.01, 0.1, 0.3, 2.5])
        rows.append((k, at(hours), rng.randrange(3), rng.choice(["error", "error", "error", "view"]), 1.0))
    return rows


def test_hopping_windows_with_late_and_repeated_rows(spark, tmp_path):
    rows = failing(1, 120)
    parts = [rows[:40], rows[40:80] + rows[30:40], [rows[90], *rows[80:90], *rows[91:]] + rows[80:85]]
    got = {(r["bead"], r["start"]): r["n"] for r in collect(S.hopping_failures(stream(spark, tmp_path, "e", parts, EVENTS)), tmp_path, "update")}
    batch = spark.createDataFrame(rows, EVENTS).where("event_type = 'error'").groupBy(F.window("ts", "1 hour", "5 minutes"), "user_id").count().where("count >= 3")
    assert got == {(r["user_id"], r["window"]["start"]): r["count"] for r in batch.collect()} and got


def test_breaker_equals_reading_in_order(spark, tmp_path):
    """Trips, blocks and expiries by batches with repeats, against one pass over all failures."""
    rows = failing(2, 200)
    parts = [rows[:50], rows[50:90] + rows[45:50], rows[90:150], rows[150:], [(10_000, at(100_000), 0, "view", 0.0)], [(10_001, at(100_001), 0, "view", 0.0)]]
    got = sorted((r["bead"], r["at"], r["action"], r["n"]) for r in collect(S.breaker(stream(spark, tmp_path, "e", parts, EVENTS)), tmp_path))
    want = []
    for bead in range(3):
        held, until = [], 0
        for _, ts, user, kind, _ in rows:
            second = int(ts.timestamp())
            if user != bead or kind != "error":
                continue
            if until and second >= until:
                want.append((bead, until, "expire", 0))
                until = 0
            if second < until:
                want.append((bead, second, "blocked", len(held)))
                continue
            held = [t for t in held if t > second - 3600] + [second]
            want.append((bead, second, "trip" if len(held) >= 3 else "count", len(held)))
            if len(held) >= 3:
                held, until = [], second + 7200
        if until:
            want.append((bead, until, "expire", 0))
    assert got == sorted(want)
    assert {r[2] for r in got} == {"trip", "blocked", "count", "expire"}
