"""From file events to an index, as a stream that may be stopped at any time.

Each micro-batch is one change, and its number says which segment it writes: base + 1 + batch. A batch that is run
again after a failure starts from the same segment before it and replaces what it left half written, so an interrupted and
restarted stream leaves the segments of an unbroken one. The base is written down when a stream begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: step(number of the segment before, files (path, content) that changed, paths (path) that went)
Step = Callable[[int, DataFrame, DataFrame], None]


def base_of(spark: SparkSession, checkpoint: str, segment: int) -> int:
    """The segment that the stream of this checkpoint began after: noted at its first start, read at each restart."""
    place = f"{checkpoint}/base"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([(segment,)], "segment int").write.mode("overwrite").parquet(place)
    return spark.read.parquet(place).first()[0]


def last_of(events: DataFrame) -> DataFrame:
    """(path, op): what the events (path, op, at) of one batch come to for each path, the latest one deciding."""
    return events.groupBy("path").agg(F.max_by("op", F.struct("at", F.when(F.col("op") == "delete", 0).otherwise(1))).alias("op"))


def applied(base: int, contents: Callable[[DataFrame], DataFrame], step: Step) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch. contents: the files (path, content) that there are of some paths; one that is gone by now is removed."""

    def sink(batch: DataFrame, number: int) -> None:
        batch = last_of(batch).persist()  # a row a path; lost blocks are computed again
        try:
            there = contents(batch.filter("op <> 'delete'").select("path"))
            removed = batch.select("path").join(there.select("path"), "path", "left_anti")
            step(base + number, there, removed)
        finally:
            batch.unpersist()

    return sink


def file_contents(root: str) -> Callable[[DataFrame], DataFrame]:
    """Contents from a folder that all executors can read; paths of events are below it."""

    def read(paths: DataFrame) -> DataFrame:
        files = paths.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        plain = files.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path"), F.col("content").cast("string").alias("content"))
        return plain.join(paths, "path", "left_semi")

    return read


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there by now, in as many batches as the source makes of it; then stop."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/stream").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
