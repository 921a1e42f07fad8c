"""Streams: windowed telemetry with a watermark, debounced file events, upserts for each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operation of a file event that stands for each event type of the driver's table.
OPERATIONS = {"signup": "create", "view": "modify", "click": "modify", "purchase": "delete", "error": "modify"}


def event_stream(spark: SparkSession, sf_dir: str, files_each: int = 1) -> DataFrame:
    """The events table as a stream; the pace is set by the source, so nothing overflows."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files_each).parquet(sf_dir)


def telemetry(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type; late events are counted until the watermark closes their window."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark asks for this type
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop; `sink` gets (batch, id) and must be idempotent by id."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def coalesced(first: str, now: str | None, new: str) -> str | None:
    """Operation after another event on the same path; None if they cancel out."""
    if first == "create":
        return {"modify": now, "delete": None}.get(new, new)
    if first == "delete" and new == "create":
        return "modify"
    return new


def debounced(events: DataFrame, key: str = "user_id", gap: str = "2 hours") -> DataFrame:
    """(key, first, last, operation, merged): for each path and quiet-window batch the one operation that its events come to.

    Events stream through a task in order of key and time, and a batch is folded as it passes: of a batch without a pause
    only its first and present operation are held.
    """
    op = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])[F.col("event_type")]
    quiet = F.expr(f"cast(unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {gap}) as bigint)")
    plain = events.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", op.alias("op"), quiet.alias("gap"))
    kind = plain.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list | None = None  # key, first and last time, first and present operation, number
        for b in batches:
            done = []
            for k, at, op, gap in zip(b["key"], b["at"], b["op"], b["gap"], strict=True):
                if held is None or held[0] != k or at - held[2] >= gap:
                    if held is not None:
                        done.append(held)
                    held = [k, at, at, op, op, 1]
                    continue
                held[2], held[5] = at, held[5] + 1
                if held[3] is None:
                    held[3] = held[4] = op
                else:
                    held[4] = coalesced(held[3], held[4], op)
                    held[3] = held[3] if held[4] is not None else None
            yield _told(done)
        yield _told([held] if held is not None else [])

    rows = plain.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(work, f"key {kind}, first long, last long, operation string, merged int")
    return rows.filter("operation is not null").withColumns({"first": F.timestamp_micros("first"), "last": F.timestamp_micros("last")})


def _told(batches: list[list]) -> pd.DataFrame:
    return pd.DataFrame([(k, first, last, now, n) for k, first, last, _, now, n in batches], columns=["key", "first", "last", "operation", "merged"])
