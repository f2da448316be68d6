"""Structured Streaming twins of the event-store plans.

Each takes a streaming (or batch) frame of events (event_id, ts, user_id, event_type, value) and returns a frame; the
batch twins in tessera.operators.events give the same rows for the same input, which the tests check.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessera.sources.catalog import exists


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Events from a folder of Parquet files, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def exactly_once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops repeats of an event id that arrive within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def failure_windows(events: DataFrame, failures: int = 3, length: str = "1 hour", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Workstreams with at least ``failures`` errors in a window of event time."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).where("event_type = 'error'")
    counted = rows.groupBy(F.window("ts", length, slide), (F.col("user_id") % 10).alias("ws")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= failures).select("ws", F.col("window.start").alias("start"), "n")


SHELVES = 64


def ingest(events: DataFrame, store: str, rejects: str, checkpoint: str):
    """Micro-batch ingest into a Parquet store: rows that break a constraint go to the reject side, known ids are skipped.

    The store is dealt out by a hash of the id, so a batch reads only the folders that its ids could be in.  One query
    may write to a store at a time: two would not see each other's rows.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("shelf", F.pmod(F.xxhash64("event_id"), F.lit(SHELVES)).cast("int"))
        good = F.col("event_id").isNotNull() & F.col("event_type").isin("error", "view", "signup", "purchase", "click")
        fresh = batch.where(good).dropDuplicates(["event_id"])
        if exists(spark, store):
            touched = [r[0] for r in fresh.select("shelf").distinct().collect()]  # SHELVES numbers at most
            known = spark.read.schema(batch.schema).parquet(store).where(F.col("shelf").isin(touched)).select("event_id")
            fresh = fresh.join(known, "event_id", "left_anti").select(*batch.columns)
        fresh.write.mode("append").partitionBy("shelf").parquet(store)
        batch.where(~F.coalesce(good, F.lit(False))).drop("shelf").write.mode("append").parquet(rejects)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_streaks(events: DataFrame) -> DataFrame:
    """Per user, the running streak of failures since the last purchase, kept in state across batches.

    The state is one number a user and stays for as long as the query: a timeout would end a streak that only pauses.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"]):
            streak = 0 if kind == "purchase" else streak + 1 if kind == "error" else streak
            if kind == "error":
                out.append((key[0], event_id, streak))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "streak"])

    rows = events.where("event_type IN ('error', 'purchase')").select("user_id", "event_id", "ts", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, streak bigint", "streak bigint", "append", GroupStateTimeout.NoTimeout)


def late_corrections(ledger: DataFrame, corrections: DataFrame, within: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Ledger entries (entry, ts, amount) with the corrections (entry, ts, amount) that come ``within`` their time, as two streams.

    Each stream has its own watermark.  An entry waits in state until no correction can reach it any more; then, if none did, it comes out alone.
    """
    x = ledger.select("entry", F.col("ts").alias("booked"), "amount").withWatermark("booked", delay)
    y = corrections.select(F.col("entry").alias("corrects"), F.col("ts").alias("corrected"), F.col("amount").alias("change")).withWatermark("corrected", delay)
    on = F.expr(f"entry = corrects AND corrected >= booked AND corrected < booked + interval {within}")
    return x.join(y, on, "leftOuter").select("entry", "booked", "amount", "corrected", "change")


def hopping_failures(events: DataFrame, failures: int = 3, delay: str = "1 hour") -> DataFrame:
    """Beads with at least ``failures`` errors in an hour, hour by hour every five minutes; repeats of an id within the watermark count once."""
    rows = exactly_once(events, delay).where("event_type = 'error'")
    counted = rows.groupBy(F.window("ts", "1 hour", "5 minutes"), F.col("user_id").alias("bead")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= failures).select("bead", F.col("window.start").alias("start"), "n")


BREAKER = "bead bigint, event_id bigint, at bigint, n int, action string"


def breaker_step(held: list[int], until: int, at: int, failures: int, seconds: int, blocked: int) -> tuple[list[int], int, int, str]:
    """(held, until, n, action) after a failure: a bead that is blocked stays so, and one whose failures of the last ``seconds`` are enough trips."""
    if at < until:
        return held, until, len(held), "blocked"
    held = [t for t in held if t > at - seconds] + [at]
    if len(held) >= failures:
        return [], at + blocked, len(held), "trip"
    return held, until, len(held), "count"


def breaker(events: DataFrame, failures: int = 3, seconds: int = 3600, blocked: int = 7200, delay: str = "1 hour") -> DataFrame:
    """A circuit breaker for each bead: every failure with what it did, and a row when a block expires.

    Repeats within the watermark count once.  The state is the failures of the last ``seconds`` and the end of a block; it is dropped by an
    event-time timer when the last of them is over, so beads that are quiet hold none.  Failures that come in one batch are taken in order of time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, until = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        if state.hasTimedOut:
            if until:
                out.append((key[0], None, until, 0, "expire"))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
            for event_id, at in zip(rows["event_id"].tolist(), rows["at"].tolist()):
                if until and at >= until:
                    out.append((key[0], None, until, 0, "expire"))
                    until = 0
                held, until, n, action = breaker_step(held, until, at, failures, seconds, blocked)
                out.append((key[0], event_id, at, n, action))
            state.update((held, until))
            state.setTimeoutTimestamp(max(1000 * max(until, max(held, default=0) + seconds), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["bead", "event_id", "at", "n", "action"]).astype({"event_id": "Int64"})

    rows = exactly_once(events, delay).where("event_type = 'error'").select(F.col("user_id").alias("bead"), "event_id", "ts", F.unix_timestamp("ts").alias("at"))
    return rows.groupBy("bead").applyInPandasWithState(step, BREAKER, "held array<bigint>, until bigint", "append", GroupStateTimeout.EventTimeTimeout)
