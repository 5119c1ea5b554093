"""Keyed expiring counters over event streams and tables.

A key has a count and an expiry. An event is allowed while the count is below the
limit; allowed events count and move the expiry to a window after themselves,
blocked ones do neither, and a count is forgotten when its expiry is strictly past.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexiloom.functions.shipping import ship_package


def gap_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = 60) -> DataFrame:
    """(key, session, started, ended, n): events of a key less than or exactly ``seconds`` apart share a session."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    marked = events.withColumn("_new", F.when(gap.isNull() | (gap > seconds * 1_000_000), 1).otherwise(0))
    marked = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))


def decide(times: list[float], limit: int, seconds: float, count: int = 0, expiry: float | None = None) -> tuple[list[bool], int, float | None]:
    """Which events in order are allowed, and the state after them."""
    out = []
    for t in times:
        if expiry is not None and expiry < t:
            count, expiry = 0, None
        allowed = count < limit
        if allowed:
            count, expiry = count + 1, t + seconds
        out.append(allowed)
    return out, count, expiry


def rate_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = 400, seconds: int = 60) -> DataFrame:
    """(key, event_id, allowed) of a table of events, exactly as the counters decide; a key's events pass in order, whatever their number."""
    ship_package(events.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, count, expiry = None, 0, None
        for batch in batches:
            allowed: list[bool] = []
            for key_, rows in batch.groupby("key", sort=False, dropna=False):
                if key_ != last:
                    last, count, expiry = key_, 0, None
                own, count, expiry = decide(rows["t"].tolist(), limit, seconds, count, expiry)
                allowed.extend(own)
            yield pd.DataFrame({"key": batch["key"], "event_id": batch["event_id"], "allowed": allowed})

    own = events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "event_id", (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return own.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(run, "key string, event_id long, allowed boolean")


class _Counters(StatefulProcessor):
    """The counter of a key, and the events that wait until the watermark has passed them, so that they are decided in order."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "count long, expiry double")
        self.waiting = handle.getListState("waiting", "t double, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            self.waiting.appendList([(float(t), int(i)) for t, i in zip(frame["t"], frame["event_id"], strict=True)])
            first = frame["t"].min() if first is None else min(first, frame["t"].min())
        if first is not None:
            self.handle.registerTimer(math.ceil(first * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        have = sorted((float(t), int(i)) for t, i in self.waiting.get())
        ready, later = [x for x in have if x[0] <= now], [x for x in have if x[0] > now]
        count, expiry = self.counter.get() if self.counter.exists() else (0, -1.0)
        allowed, count, expiry = decide([t for t, _ in ready], self.limit, self.seconds, count, None if expiry < 0 else expiry)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(math.ceil(later[0][0] * 1000))
        else:
            self.waiting.clear()
        if not later and (expiry is None or expiry < now):
            self.counter.clear()  # forgotten: nothing of the key is left
        else:
            self.counter.update((count, -1.0 if expiry is None else expiry))
            if not later:
                self.handle.registerTimer(math.floor(expiry * 1000) + 1)
        return iter([pd.DataFrame({"key": [key[0]] * len(ready), "event_id": [i for _, i in ready], "allowed": allowed})] if ready else [])

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = 400, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """The same over a stream whose events come in any order, up to ``late`` behind the latest one; later ones are dropped.

    An event is decided once the watermark has passed it, so the stream tells what the
    table does. A key's state is an event that waits or a counter that hasn't expired; a timer
    at the expiry takes the rest away. Needs the RocksDB state store, which is set for the session.
    """
    spark = events.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col(ts).cast("timestamp").alias("at"))
    own = own.withColumn("t", F.unix_micros("at") / 1e6).withWatermark("at", late)
    return own.groupBy("key").transformWithStateInPandas(_Counters(limit, seconds), "key string, event_id long, allowed boolean", "append", "eventTime")
