"""Vectors of contents, kept from one build to the next by content and model, and providers that stand in for one another.

A cache is a folder that all executors share: for each model, rows (key, embedding) by the run that made them, and the keys
each run used. Contents are looked up by their digest; only those that no earlier run embedded are. A run that
failed before its keys were noted is replaced by the next. Vectors that no run of late has used are dropped when the cache is swept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (id long, content) to (id long, embedding)
Embed = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Provider:
    """A model by name; its vectors are never mixed with those of another."""

    model: str
    embed: Embed


@dataclass(frozen=True)
class Cache:
    spark: SparkSession
    path: str

    def _place(self, model: str, what: str) -> str:
        return f"{self.path}/model={model}/{what}"

    def rows(self, model: str, what: str = "rows", schema: str = "key string, embedding array<float>, run int") -> DataFrame:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._place(model, what))
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._place(model, what))

    def used(self, model: str) -> DataFrame:
        return self.rows(model, "used", "key string, run int")

    def next_run(self, model: str) -> int:
        return (self.used(model).agg(F.max("run")).first()[0] or 0) + 1

    def embedded(self, contents: DataFrame, providers: list[Provider]) -> tuple[DataFrame, str]:
        """((key, embedding) of the distinct contents (column content), the model that gave them): the first provider that doesn't fail."""
        keys = contents.select(F.sha2("content", 256).alias("key"), "content").groupBy("key").agg(F.min("content").alias("content"))
        problems = []
        for p in providers:
            run = self.next_run(p.model)
            known = self.rows(p.model).filter(F.col("run") < run)
            lacking = keys.join(known.select("key"), "key", "left_anti")
            numbered = lacking.select(F.xxhash64("key").alias("id"), "key", "content")
            try:
                made = p.embed(numbered.select("id", "content")).join(numbered.select("id", "key"), "id").select("key", "embedding")
                made.write.mode("overwrite").parquet(self._place(p.model, f"rows/run={run}"))
            except Exception as problem:  # whatever a provider throws, the next one is asked
                problems.append(f"{p.model}: {str(problem)[:200]}")
                continue
            keys.select("key").write.mode("overwrite").parquet(self._place(p.model, f"used/run={run}"))
            return self.rows(p.model).filter(F.col("run") <= run).join(keys.select("key"), "key", "left_semi").select("key", "embedding"), p.model
        raise RuntimeError("no provider of vectors is left: " + "; ".join(problems))

    def sweep(self, model: str, since: int) -> int:
        """Write the vectors that a run from `since` on used as one run (0), drop all others; how many were dropped. If it is cut short
        between both, contents are embedded again when they are next asked for."""
        rows = self.rows(model)
        kept = rows.join(self.used(model).filter(F.col("run") >= since).select("key").distinct(), "key", "left_semi").select("key", "embedding")
        before = rows.count()
        kept.write.mode("overwrite").parquet(self._place(model, "swept/run=0"))
        after = self.spark.read.parquet(self._place(model, "swept/run=0")).count()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        old, new = (jvm.org.apache.hadoop.fs.Path(self._place(model, x)) for x in ("rows", "swept"))
        files = old.getFileSystem(conf)
        files.delete(old, True)
        files.rename(new, old)
        return before - after
