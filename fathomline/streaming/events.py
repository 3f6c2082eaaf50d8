"""Structured Streaming counterparts of the log operators: windows with watermarks, sessions, quotas, states, sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_files(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Events from Parquet files as they arrive; files_per_trigger bounds a batch."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, total) of closed windows; events later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    """(start, events) of closed sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, events) of closed sessions; an event exactly a gap later begins a new one."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def first_seen(events: DataFrame, keys: list[str], within: str) -> DataFrame:
    """The first event of each key; equal ones within the watermark share its run."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def token_bucket(events: DataFrame, per_minute: int, idle_minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, wait): a bucket for each user, kept as state and dropped once event time has left it idle.

    A batch's events of a user are taken in time order. wait is 0 for an admitted event, else seconds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        have, last = state.get if state.exists else (float(per_minute), rows["ts"].iloc[0].timestamp())
        waits = []
        for now in rows["ts"]:
            have = min(float(per_minute), have + (now.timestamp() - last) * per_minute / 60)
            last = now.timestamp()
            waits.append(0.0 if have >= 1 else (1 - have) * 60 / per_minute)
            have -= have >= 1
        state.update((float(have), float(last)))
        state.setTimeoutTimestamp(int(max(last * 1000, state.getCurrentWatermarkMs())) + idle_minutes * 60_000)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "wait": waits})

    seen = events.withWatermark("ts", late).groupBy("user_id")
    return seen.applyInPandasWithState(step, "user_id long, event_id long, wait double", "have double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def newest_state(events: DataFrame) -> DataFrame:
    """(user_id, state, event_id): each job's last state so far; for output mode update or complete."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("event_id"))


def fan_out(events: DataFrame, paths: dict[str, str], checkpoint: str):
    """Write each batch to several sinks, split by event type; a batch that is repeated replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, path in paths.items():
            batch.filter(F.col("event_type") == kind).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
