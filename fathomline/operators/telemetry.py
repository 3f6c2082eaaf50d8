"""Logs as tables: windows, sessions, retention, quotas, caches, refresh schedules and job states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: The longest wait of a failing source, in seconds, unless its interval is longer.
LONGEST_WAIT = 86_400


def seconds(ts: str = "ts") -> Column:
    """A time as microseconds since the epoch."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session_start, session_end, events): runs of a key's events with no larger gap between them."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    fresh = F.coalesce(((seconds(ts) - F.lag(seconds(ts)).over(w)) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("events"))


def folded(df: DataFrame, key: str, order: list[str], columns: list[str], out: str, start: Callable, step: Callable) -> DataFrame:
    """A sequential walk over each key's rows in order: step(state, row) -> (state, result).

    Rows are dealt by key and sorted within partitions, then stream through: a key of any length holds one state.
    """
    rows = df.select(key, *order, *columns).repartition(key).sortWithinPartitions(key, *order)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b in batches:
            results = []
            for row in b.to_pylist():
                if row[key] != last:
                    last, state = row[key], start()
                state, result = step(state, row)
                results.append(result)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results, b_type)], names=[*names, out.split()[0]])

    b_type = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}[out.split()[1]]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {out}")


def token_bucket(events: DataFrame, key: str, micros: str, per_minute: int) -> DataFrame:
    """events with wait: 0 where the key still had a token, else the seconds until it has one."""

    def step(state: tuple[float, float] | None, row: dict) -> tuple[tuple[float, float], float]:
        now = row[micros] / 1e6
        have, last = state or (float(per_minute), now)
        have = min(float(per_minute), have + (now - last) * per_minute / 60)
        return ((have - 1, now), 0.0) if have >= 1 else ((have, now), (1 - have) * 60 / per_minute)

    return folded(events, key, [micros, "event_id"], [], "wait double", lambda: None, step)


def throttled(events: DataFrame, key: str, micros: str, interval_seconds: float) -> DataFrame:
    """events with told: how many notices an event sends on (itself and those held back before it); 0 if it is held back."""

    def step(state: tuple[float | None, int], row: dict) -> tuple[tuple[float | None, int], int]:
        last, held = state
        if last is None or row[micros] - last >= interval_seconds * 1e6:
            return (row[micros], 0), held + 1
        return (last, held + 1), 0

    return folded(events, key, [micros, "event_id"], [], "told long", lambda: (None, 0), step)


def cache_hits(events: DataFrame, key: str, micros: str, ttl_seconds: float) -> DataFrame:
    """events with hit: whether an entry stored for the key is not older than ttl; a miss stores a new one."""

    def step(stored: int | None, row: dict) -> tuple[int, bool]:
        hit = stored is not None and row[micros] - stored <= ttl_seconds * 1e6
        return (stored if hit else row[micros]), hit

    return folded(events, key, [micros, "event_id"], [], "hit boolean", lambda: None, step)


def in_order(events: DataFrame, key: str, sequence: str, arrived: str) -> DataFrame:
    """events with late: whether a higher sequence of the key arrived before; late writes are refused."""
    w = Window.partitionBy(key).orderBy(arrived).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("late", F.coalesce(F.max(sequence).over(w) > F.col(sequence), F.lit(False)))


def refresh_due(last: Column, interval: Column, failures: Column) -> Column:
    """When a source is checked next; null where it never is (interval null or not positive)."""
    cap = F.greatest(F.lit(float(LONGEST_WAIT)), interval)
    return F.when(interval > 0, last + T.backoff(interval, failures, cap))


def job_states(log: DataFrame, job: str, order: str, state: str) -> DataFrame:
    """(job, state, steps): each job's last state."""
    return log.groupBy(job).agg(F.max_by(state, order).alias("state"), F.count(F.lit(1)).alias("steps"))


def latency_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p50, p95, mean): nearest-rank percentiles, exact; the mean to one decimal."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.round(F.avg(value), 1).alias("mean"))


def admitted(queue: DataFrame, lane: str, order: str, size: str, budget: int) -> DataFrame:
    """queue with admitted: whether a lane's backlog up to and with a row fits the budget; a lane's first row always does."""
    w = Window.partitionBy(lane).orderBy(order)
    return queue.withColumn("admitted", (F.sum(size).over(w) <= budget) | (F.row_number().over(w) == 1))


def packed_parts(passages: DataFrame, doc: str, ordinal: str, size: str, budget: int) -> DataFrame:
    """(doc, ordinal, part): consecutive passages in parts of at most budget; a larger passage is a part of its own."""

    def step(state: tuple[int, int], row: dict) -> tuple[tuple[int, int], int]:
        part, used = state
        n = min(row[size], budget)
        if used and used + n > budget:
            part, used = part + 1, 0
        return (part, used + n), part

    return folded(passages, doc, [ordinal], [size], "part long", lambda: (1, 0), step).select(doc, ordinal, "part")


def batch_shares(needs: DataFrame, key: str, doc: str, need: str, most: int) -> DataFrame:
    """(key, doc, share): how many of most parts each document may use: what it needs, or an even split of what smaller ones leave.

    By need, documents take all they need as long as an even split of the rest gives them that; from the first that it
    doesn't on, the rest is split evenly, the last ones taking one more. Each gets one at least. Two windows over a key's
    documents, which spill; a null or smaller need counts as one.
    """
    asked = F.greatest(F.coalesce(F.col(need), F.lit(1)), F.lit(1)).cast("long")
    w = Window.partitionBy(key).orderBy("__need", doc)
    rows = needs.select(key, doc, asked.alias("__need")).withColumn("__place", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    rows = rows.withColumn("__rest", F.lit(most) - (F.sum("__need").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__need"))).withColumn("__left", F.col("__n") - F.col("__place") + 1)
    short = F.when(F.col("__need") > F.floor(F.col("__rest") / F.col("__left")), F.struct("__place", "__rest", "__left"))
    rows = rows.withColumn("__cut", F.min(short).over(Window.partitionBy(key)))
    cut = lambda c: F.col(f"__cut.{c}")
    even, more = F.floor(cut("__rest") / cut("__left")), cut("__rest") % cut("__left")
    split = even + F.when(F.col("__place") - cut("__place") >= cut("__left") - more, 1).otherwise(0)
    share = F.when(cut("__place").isNull() | (F.col("__place") < cut("__place")), F.col("__need")).otherwise(F.greatest(split, F.lit(1)))
    return rows.select(key, doc, share.cast("long").alias("share"))
