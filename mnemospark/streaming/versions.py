"""Supersession of edges as a stateful stream whose result does not depend on how the input is split or ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

TRIPLE = ["in_id", "relation", "out_id"]
OUT = "in_id string, relation string, out_id string, edge_id string, t_invalid timestamp_ntz, t_invalid_ingested timestamp_ntz"
_WAITING = "t_ingested long, t_valid long, edge_id string"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Supersede(StatefulProcessor):
    """For one triple: versions that came and wait for the watermark, and open versions in falling order of valid time. An
    event-time timer at a version's transaction time tells that no earlier one can come; it is then put in order, closes
    those open ones that are not later in valid time, and is open itself. An open version whose transaction time is older
    than ttl (microseconds, 0: never) is forgotten, and so stays open for good."""

    def __init__(self, ttl: int = 0):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.open = handle.getListState("waiting", _WAITING), handle.getListState("open", _WAITING)

    def handleInputRows(self, key, rows, timerValues):
        new, at = [], set()
        for part in rows:
            for i, v, e in zip(part["t_ingested"].astype("int64"), part["t_valid"].astype("int64"), part["edge_id"]):
                new.append((int(i), int(v), str(e)))
                at.add(int(i) // 1000 + 1)  # the first millisecond after it
        if new:
            self.waiting.appendList(new)
            for t in at:
                self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        if rows and len(later) < len(rows):
            self.waiting.put(later) if later else self.waiting.clear()
        stack = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        before, closed = list(stack), []
        for i, v, e in ready:
            while stack and stack[-1][1] <= v:
                closed.append((stack.pop()[2], v, i))
            stack.append((i, v, e))
        if self.ttl:
            stack = [r for r in stack if r[0] + self.ttl > mark]
            for r in stack:
                self.handle.registerTimer((r[0] + self.ttl) // 1000 + 1)  # state ends then
        if stack != before:
            self.open.put(stack) if stack else self.open.clear()
        if closed:
            times = lambda k: pd.to_datetime([c[k] for c in closed], unit="us")
            yield pd.DataFrame({**dict(zip(TRIPLE, key)), "edge_id": [c[0] for c in closed], "t_invalid": times(1), "t_invalid_ingested": times(2)})

    def close(self) -> None:
        pass


def supersede(stream: DataFrame, delay: str = "1 day", ttl_seconds: int = 0) -> DataFrame:
    """Versions (edge_id, in_id, relation, out_id, t_valid, t_ingested) to closures: what close_superseded gives over all of
    them, each once the watermark (delay behind the latest transaction time) has passed its closer. Versions that come
    later than the delay are left out, as everywhere in streams. Needs the RocksDB state store: see STORE."""
    at = stream.withColumn("event_time", F.col("t_ingested").cast("timestamp")).withWatermark("event_time", delay)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = at.select(*TRIPLE, "edge_id", micros("t_valid").alias("t_valid"), micros("t_ingested").alias("t_ingested"), "event_time").where("t_valid IS NOT NULL AND t_ingested IS NOT NULL")
    return rows.groupBy(*TRIPLE).transformWithStateInPandas(Supersede(ttl_seconds * 1_000_000), OUT, "Append", "EventTime")
