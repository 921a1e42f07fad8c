"""Secrets, chunks and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import chunking, secrets
from gleaner.plans.texts import path_of
from gleaner.registry import query
from gleaner.session import scratch, table
from gleaner.streaming import debounce, followed
from gleaner.streaming import events as streams


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(path_of().alias("path"), F.col("text").alias("content"))


_ASSIGNED = next(pattern for name, pattern, *_ in secrets.DETECTORS if name == "generic-secret-assignment")


@query(f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_ASSIGNED.replace("'", "''")}', 1)) AS v FROM documents) SELECT doc_id, count(*) AS n FROM f GROUP BY 1""")
def secret_assignments(spark, sf_dir):
    """Documents with a secret assigned to a name, by the detector's pattern as a native expression."""
    found = F.regexp_extract_all("text", F.lit(_ASSIGNED), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n")).filter("n > 0")


@query()
def secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def secret_redact(spark, sf_dir):
    return secrets.guarded(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", F.sha2("text", 256).alias("text_sha"))


@query()
def chunk_lines(spark, sf_dir):
    return chunking.chunks(files(spark, sf_dir), chunking.by_lines, "lines").drop("content")


@query()
def chunk_sections(spark, sf_dir):
    return chunking.chunks(files(spark, sf_dir), chunking.by_sections, "section").drop("content")


@query()
def chunk_symbols(spark, sf_dir):
    return chunking.chunks(files(spark, sf_dir), chunking.by_symbols, "symbol").drop("content")


@query("""SELECT page_id, (s.i - 1)::INTEGER AS part, substr(html, (s.i - 1) * 2048 + 1, 2048) AS content FROM pages, LATERAL (SELECT unnest(generate_series(1, greatest(1, (length(html) + 2047) // 2048))) AS i) s""")
def chunk_fixed(spark, sf_dir):
    """Windows of a fixed size: an explode over a sequence, native throughout."""
    n = F.greatest(F.lit(1), F.ceil(F.length("html") / 2048).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return p.select("page_id", "part", F.substring("html", F.col("part") * 2048 + 1, F.lit(2048)).alias("content"))


@query()
def debounce_coalesce(spark, sf_dir):
    return streams.debounced(table(spark, sf_dir, "events"))


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_telemetry(spark, sf_dir):
    """The stream run to its end: each micro-batch's windows replace those of an earlier attempt at the same batch."""
    out = scratch(spark, "telemetry")

    def sink(batch, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    streams.run_to_end(streams.telemetry(streams.event_stream(spark, sf_dir)), sink, scratch(spark, "telemetry-state"), mode="update")
    windows = spark.read.parquet(out)  # update mode: the latest batch of a window holds its value
    last = windows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select(F.unix_timestamp("start").alias("start"), "event_type", "v.n", F.round("v.total", 4).alias("total"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, count(*) AS seen FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    """Latest event of each user, upserted by foreachBatch into a versioned table: a batch that runs again replaces its own version."""
    out = scratch(spark, "upsert")

    def sink(batch, batch_id: int) -> None:
        new = batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count("*").alias("seen"))
        if batch_id:
            old = spark.read.parquet(f"{out}/v={batch_id - 1}")
            new = old.unionByName(new).groupBy("user_id").agg(F.max("last").alias("last"), F.sum("seen").alias("seen"))
        new.write.mode("overwrite").parquet(f"{out}/v={batch_id}")

    streams.run_to_end(streams.event_stream(spark, sf_dir), sink, scratch(spark, "upsert-state"))
    versions = spark.read.parquet(out)
    return versions.join(versions.agg(F.max("v").alias("v")), "v").select("user_id", "last.event_type", "seen")


_GAP, _OPS = 2 * 3600 * 1_000_000, " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in streams.OPERATIONS.items())
_NEXT = "CASE WHEN s.was = 'create' THEN CASE e.op WHEN 'modify' THEN s.now WHEN 'delete' THEN NULL ELSE e.op END WHEN s.was = 'delete' AND e.op = 'create' THEN 'modify' ELSE e.op END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS us, CASE event_type {_OPS} END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s(key, n, first, last, was, now, merged) AS (SELECT key, n, us, us, op, op, 1 FROM e WHERE n = 1
 UNION ALL SELECT e.key, e.n, CASE WHEN e.us - s.last >= {_GAP} THEN e.us ELSE s.first END, e.us,
  CASE WHEN e.us - s.last >= {_GAP} OR s.was IS NULL THEN e.op WHEN {_NEXT} IS NULL THEN NULL ELSE s.was END,
  CASE WHEN e.us - s.last >= {_GAP} OR s.was IS NULL THEN e.op ELSE {_NEXT} END,
  CASE WHEN e.us - s.last >= {_GAP} THEN 1 ELSE s.merged + 1 END FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
SELECT key AS user_id, first, last, now AS operation, merged FROM (SELECT *, row_number() OVER (PARTITION BY key, first ORDER BY n DESC) AS latest FROM s) WHERE latest = 1 AND now IS NOT NULL""")
def stream_debounce(spark, sf_dir):
    """Debounced events of an endless stream: four stretches of time, the stream stopped and started again after each, then an
    event without a path that lets the watermark pass all others."""
    events, place, out, state = table(spark, sf_dir, "events"), scratch(spark, "debounce-in"), scratch(spark, "debounced"), scratch(spark, "debounce-state")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    stretch = F.least(F.floor((at - lo) * 4 / F.lit(max(1, hi - lo))), F.lit(3))

    def run() -> None:
        found = debounce.debounced_stream(spark.readStream.schema(events.schema).parquet(place))
        found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()

    for k in range(4):
        events.filter(stretch == k).write.mode("append").parquet(place)
        run()
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields if f.name != "ts"]
    end = events.agg((F.max("ts") + F.expr("interval 9 hours")).alias("ts"), F.count("*").alias("n")).select("ts", *none)
    end.select(*[F.col(c).cast(events.schema[c].dataType) for c in events.columns]).write.mode("append").parquet(place)
    run()
    return spark.read.parquet(out).select(F.col("key").alias("user_id"), "first", "last", "operation", "merged")


@query("""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT source, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM l GROUP BY 1""")
def followed_lines(spark, sf_dir):
    """Lines of all documents by source, read by a stream that follows the folder to which they are appended in two parts."""
    docs, place, state, out = table(spark, sf_dir, "documents"), scratch(spark, "lines"), scratch(spark, "lines-state"), scratch(spark, "lines-out")
    spark.dataSource.register(followed.FollowedLines)
    for part in (0, 1):
        rows = docs.filter(F.col("doc_id") % 2 == part).select("source", F.explode(F.split("text", "\n")).alias("line"))
        rows.select(F.concat_ws("\t", "source", "line").alias("value")).write.mode("append").text(place)
        stream = spark.readStream.format("followed_lines").option("path", place).option("ledger", f"{state}/ledger").load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{state}/stream").start(out)
        q.processAllAvailable()
        q.stop()
    parts = F.split("line", "\t", 2)
    return spark.read.parquet(out).groupBy(parts[0].alias("source")).agg(F.count("*").alias("lines"), F.sum(F.length(parts[1])).cast("long").alias("chars"))
