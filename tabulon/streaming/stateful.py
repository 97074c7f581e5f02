"""Streams with state of their own: the first event of each key with late corrections and time-outs, and events that follow others."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State of any kind is kept by this provider; a session that runs first_events names it in this setting.
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstEvents(StatefulProcessor):
    """Keeps each key's earliest event by (ts, event_id), and gives it again whenever an earlier one comes late.

    A key that has had no event for `idle_ms` of event time is given once more as closed, and forgotten.
    """

    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "event_id long, ts_us long, value double, times int")

    def _row(self, key, kept: tuple, kind: str) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "event_id": [kept[0]], "ts_us": [kept[1]], "value": [kept[2]], "times": [kept[3]], "kind": [kind]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = tuple(self.first.get()) if self.first.exists() else None
        best = had
        for batch in rows:
            for event, ts, value in zip(batch["event_id"], batch["ts_us"], batch["value"], strict=True):
                if best is None or (ts, event) < (best[1], best[0]):
                    best = (int(event), int(ts), float(value), 0)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle_ms)
        if had is None or best[:2] != had[:2]:
            best = (*best[:3], (had[3] if had else 0) + 1)
            self.first.update(best)
            yield self._row(key, best, "first" if had is None else "corrected")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = tuple(self.first.get())
        self.first.clear()
        yield self._row(key, kept, "closed")

    def close(self) -> None:
        pass


def first_events(stream: DataFrame, key: str = "user_id", late: str = "1 hour", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """key, event_id, ts_us, value, times, kind of a stream of events (key, event_id, ts, value): first, corrected or closed.

    The last row of each key is its first event, as the batch form has it, unless an event came later than `late` behind the
    others. Keys are longs; null ones are one key. State is one small row for each key that isn't closed.
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(key, "event_id", "ts", F.unix_micros("ts").alias("ts_us"), F.col("value").cast("double").alias("value"))
    schema = f"{key} long, event_id long, ts_us long, value double, times int, kind string"
    return timed.groupBy(key).transformWithStateInPandas(FirstEvents(key, idle_ms), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def followed(events: DataFrame, first: str, then: str, within: str = "1 day", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """key, first_id, then_id: each event of one kind with those of another kind of the same key that follow it within a time.

    On a stream both sides stand under watermarks, so state holds no more than the events of that time.
    """
    ts = F.col("ts").cast("timestamp")
    side = lambda kind, name: events.filter(F.col("event_type") == kind).select(F.col(key).alias(f"{name}_key"), F.col("event_id").alias(f"{name}_id"), ts.alias(f"{name}_ts"))
    a, b = side(first, "first"), side(then, "then")
    if events.isStreaming:
        a, b = a.withWatermark("first_ts", late), b.withWatermark("then_ts", late)
    near = F.expr(f"first_key = then_key AND then_ts >= first_ts AND then_ts <= first_ts + INTERVAL {within}")
    return a.join(b, near).select(F.col("first_key").alias(key), "first_id", "then_id")
