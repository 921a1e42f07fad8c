"""Stages of a build or change: what each wrote, and where an interrupted one goes on.

A build notes, in its folder, the digest of its input and each stage that is done. A build that is started again with the same
input skips those; with another input, or after a finished build, it starts anew. What stages wrote is kept in an append-only
table `runs` (segment, stage, started, seconds, rows, note); rows are counted while they are written.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNS = "segment int, stage string, started timestamp, seconds double, rows long, note string"


def digest_of(files: DataFrame) -> str:
    """A digest of rows in any order."""
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n}-{total}".replace("--", "-m")


class Stages:
    """The stages of one build or change under a folder. digest: of its input, if it may go on where it stopped."""

    def __init__(self, spark: SparkSession, path: str, segment: int, digest: str | None = None):
        self.spark, self.path, self.segment, self.rows = spark, path, segment, []
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.resumes = digest is not None
        if self.resumes and not self._there(f"of-{digest}"):
            self.files.delete(place, True)
            self._mark(f"of-{digest}")

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/build/{name}")

    def _there(self, name: str) -> bool:
        return self.files.exists(self._at(name))

    def _mark(self, name: str) -> None:
        self.files.create(self._at(name), True).close()

    def run(self, stage: str, work: Callable[[], object]) -> None:
        """Do a stage unless it is done; an int that `work` returns is its number of rows, a text a note."""
        if self.resumes and self._there(f"done-{stage}"):
            self.rows.append((self.segment, stage, datetime.now(UTC), 0.0, None, "done before"))
            return
        began, at = time.perf_counter(), datetime.now(UTC)
        told = work()
        self.rows.append((self.segment, stage, at, time.perf_counter() - began, told if isinstance(told, int) else None, told if isinstance(told, str) else None))
        if self.resumes:
            self._mark(f"done-{stage}")

    def finish(self) -> None:
        """Write what was done, and forget how far the build came."""
        self.spark.createDataFrame(self.rows, RUNS).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")  # a few rows
        self.files.delete(self._at(""), True)


def counted(rows: DataFrame, write: Callable[[DataFrame], object]) -> int:
    """Write rows and say how many there were, in one pass."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    return int(seen.get["rows"])


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(f"{path}/runs")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(stage, segment, seconds, rows, note, runs): the last run of each stage, and how often it ran."""
    last = F.max_by(F.struct("segment", "seconds", "rows", "note"), F.struct("started", "segment"))
    return runs(spark, path).groupBy("stage").agg(last.alias("x"), F.count("*").alias("runs")).select("stage", "x.*", "runs")
