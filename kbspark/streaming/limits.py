"""Rate limits, one vote a day and throttles on live streams: state of a key with a timer that lets it go.

The rules are those of operators.integrity, event by event. Events of a micro-batch are judged in the order of time, those
of later batches after them; rows older than the watermark are dropped by Spark. State lives in RocksDB, so keys need not
fit in memory, and is cleared as soon as the watermark says that no event to come can be touched by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What transformWithState asks for; a checkpoint must go on with the store that it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _micros(ts: pd.Series) -> list[int]:
    return [int(x) for x in ts.astype("datetime64[us]").astype("int64")]


class _Judge(StatefulProcessor):
    """Rows of a key in the order of time, each with a verdict; subclasses hold times (microseconds) as their state."""

    state, column = "", ""

    def __init__(self, order: list[str], life: int, most: int):
        self.order, self.life, self.most = order, life * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable", ignore_index=True)  # of one key and micro-batch
        before = self.held.get() if self.held.exists() else None
        verdicts, after = self.judge(frame, before)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(self.ends(before))
            self.held.update(after)
            self.handle.registerTimer(self.ends(after))
        frame[self.column] = verdicts
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            self.held.clear()
        return iter(())

    def ends(self, held: tuple) -> int:
        """Milliseconds from which the state matters no more, rounded up."""
        return -(-(self.last(held) + self.life) // 1000)

    def close(self) -> None:
        pass


class Accepted(_Judge):
    """At most `most` of a key within a life that every accepted event renews."""

    state, column = "count int, last long", "accepted"

    def judge(self, frame, held):
        count, last = held or (0, None)
        out = []
        for ts in _micros(frame["ts"]):
            if last is not None and ts - last >= self.life:
                count = 0
            out.append(count < self.most)
            if out[-1]:
                count, last = count + 1, ts
        return out, (count, last)

    def last(self, held):
        return held[1]


class Throttled(_Judge):
    """spam; throttled where `most` of the key were stored within the life before; else stored."""

    state, column = "times array<long>", "outcome"

    def judge(self, frame, held):
        times = list(held[0]) if held else []
        out = []
        for ts, spam in zip(_micros(frame["ts"]), frame["spam"].tolist()):
            if spam:
                out.append("spam")
            elif len(times) == self.most and ts - times[0] < self.life:
                out.append("throttled")
            else:
                out.append("stored")
                times = [*times, ts][-self.most :]
        return out, ((times,) if times else held)

    def last(self, held):
        return held[0][-1]


def _judged(events: DataFrame, key: list[str], judge: _Judge, kind: str, late: str) -> DataFrame:
    keep_state_in_rocksdb(events.sparkSession)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema)}, {judge.column} {kind}"
    return events.where("ts is not null").withWatermark("ts", late).groupBy(*key).transformWithStateInPandas(judge, schema, "append", "eventTime")


def accepted_stream(events: DataFrame, key: list[str], seconds: int, most: int, late: str = "1 minute") -> DataFrame:
    """A stream of events(…, ts) with `accepted`, as integrity.accepted(); events without a time are left out."""
    rest = [c for c in events.columns if c not in (*key, "ts")]
    return _judged(events, key, Accepted(["ts", *rest], seconds, most), "boolean", late)


def throttled_stream(events: DataFrame, key: list[str], seconds: int = 3600, most: int = 5, late: str = "1 minute") -> DataFrame:
    """A stream of events(…, ts, spam) with `outcome`, as integrity.throttled(); events without a time are left out."""
    rest = [c for c in events.columns if c not in (*key, "ts")]
    return _judged(events, key, Throttled(["ts", *rest], seconds, most), "string", late)
