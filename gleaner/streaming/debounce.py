"""Debouncing of file events on an endless stream: one operation for each path and quiet-window batch, as `events.debounced` gives in batch.

State of a path: the open batch (its first and last time, what it comes to, how many events) and the events that the watermark
hasn't passed, as earlier ones may still come. Events are folded in order once the watermark passes them, and a
timer at the end of the quiet window closes the batch, so state is held for open paths only and an open batch of any length
takes one row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gleaner.streaming.events import OPERATIONS, coalesced

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap  # microseconds

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, was string, now string, merged int")
        self.pending = handle.getListState("pending", "at long, event long, op string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        self.pending.appendList([(r["micros"], r["event_id"], r["op"]) for r in rows])
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, passed: int) -> Iterator[Row]:
        waiting = [tuple(x) for x in self.pending.get()]
        held = tuple(self.open.get()) if self.open.exists() else None
        ready = sorted((x for x in waiting if x[0] < passed), key=lambda x: x[:2])
        for at, _, op in ready:
            if held is not None and at - held[1] >= self.gap:
                yield self._told(key, held)
                held = None
            if held is None:
                held = (at, at, op, op, 1)
                continue
            first, _, was, now, n = held
            was, now = (op, op) if was is None else (was, coalesced(was, now, op))
            held = (first, at, was if now is not None else None, now, n + 1)
        if held is not None and held[1] + self.gap <= passed:
            yield self._told(key, held)
            held = None
        rest = [x for x in waiting if x[0] >= passed]
        self.pending.put(rest) if rest else self.pending.clear()
        self.open.update(held) if held is not None else self.open.clear()
        due = [x[0] for x in rest] + ([held[1] + self.gap] if held is not None else [])
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)

    @staticmethod
    def _told(key, held: tuple) -> Row:
        return Row(key=key[0], first=held[0], last=held[1], operation=held[3], merged=held[4])

    def close(self) -> None: ...


def debounced_stream(events: DataFrame, key: str = "user_id", gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(key, first, last, operation, merged) of a stream of events (event_id, ts, event_type, key); times in microseconds.

    A batch is given out when the watermark passes the end of its quiet window.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    op = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])[F.col("event_type")]
    quiet = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {gap})").first()[0]
    ts = F.col("ts").cast("timestamp")
    plain = events.select(F.col(key).alias("key"), ts.alias("ts"), F.unix_micros(ts).alias("micros"), F.col("event_id").cast("long").alias("event_id"), op.alias("op"))
    kind = plain.schema["key"].dataType.simpleString()
    out = f"key {kind}, first long, last long, operation string, merged int"
    rows = plain.withWatermark("ts", late).groupBy("key").transformWithState(Debounce(quiet), out, "Append", "EventTime")
    return rows.filter("operation IS NOT NULL")
