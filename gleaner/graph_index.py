"""The graph of files as stored tables that follow every change, in whatever order files come and go.

An import, a test's name or a mention may mean several files, most of which don't exist (yet). Each such candidate is kept
in `wanted`, by the bucket of the file it hopes for. A change looks up the paths that came or went in their buckets, and so
finds the sources, themselves unchanged, whose references now mean something else; only these and the changed files are
resolved again. The live edges are those of a build from the same files, edges of unchanged files included.

Tables, by segment: paths (path), nodes, edges, wanted (path, how, target, file, confidence, bucket). An edge whose end
is gone stays, marked stale, until it is purged or its end comes back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.joins import bounded
from gleaner.operators import code
from gleaner.sources import segments

#: Tables of the graph and the key by which a change removes rows.
KEYS = {"paths": "path", "nodes": "path", "edges": "id", "wanted": "path"}
WANTED = "path string, how string, target string, file string, confidence double, bucket int"
#: Candidates in a bucket, about, and buckets at most.
PER_BUCKET, BUCKETS = 20_000, 1024


@dataclass(frozen=True)
class GraphIndex:
    """The graph in one folder, as of a segment."""

    spark: SparkSession
    path: str
    segment: int
    project: str = "project"

    def table(self, name: str) -> DataFrame:
        return segments.live(self.spark, f"{self.path}/{name}", KEYS[name], self.segment, WANTED if name == "wanted" else None).drop("segment")

    @property
    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.path}/wanted/layout").first()[0]

    def links(self) -> DataFrame:
        """(kind, src, dst, confidence) of the live edges."""
        return self.table("edges").filter(~F.col("stale")).select("kind", "src", "dst", "confidence")


def _bucket(file: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(buckets)).cast("int")


def _put(path: str, name: str, n: int, rows: DataFrame, gone: DataFrame) -> None:
    by = ("bucket",) if name == "wanted" else ()
    segments.put(f"{path}/{name}", n, rows.repartition("bucket") if by else rows, gone, by)


def build(path: str, files: DataFrame, project: str = "project", more: tuple[DataFrame, DataFrame] | None = None) -> GraphIndex:
    """Write the graph of files (path, content) as segment 0. more: further nodes and edges, such as those of chunks."""
    spark, now = files.sparkSession, GraphIndex(files.sparkSession, path, 0, project)
    hopes = code.wanted(files)
    buckets = max(1, min(BUCKETS, hopes.count() // PER_BUCKET))
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/wanted/layout")
    rows = hopes.withColumn("bucket", _bucket(F.col("file"), buckets))
    _put(path, "wanted", 0, rows, rows.select("path").limit(0))
    paths = files.select("path").distinct()
    _put(path, "paths", 0, paths, paths.limit(0))
    nodes, edges = _with(code.own_graph(files, project), more)
    _put(path, "nodes", 0, nodes, nodes.select("path").limit(0))
    edges = edges.unionByName(code.cross_edges(now.table("wanted"), now.table("paths"), project))
    _put(path, "edges", 0, edges, edges.select("id").limit(0))
    return now


def _with(graph: tuple[DataFrame, DataFrame], more: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    return graph if more is None else (graph[0].unionByName(more[0]), graph[1].unionByName(more[1]))


def change(before: GraphIndex, changed: DataFrame, removed: DataFrame, more: tuple[DataFrame, DataFrame] | None = None) -> GraphIndex:
    """The graph after files (path, content) changed or came and paths (path) went, as the next segment. Written again, it is replaced."""
    spark, path, n, project = before.spark, before.path, before.segment + 1, before.project
    now, buckets = GraphIndex(spark, path, n, project), before.buckets
    gone = changed.select("path").union(removed.select("path")).distinct()
    _put(path, "paths", n, changed.select("path").distinct(), gone)
    gone = spark.read.parquet(f"{path}/paths/gone/segment={n}")  # read from here on, not made again
    hopes = code.wanted(changed).withColumn("bucket", _bucket(F.col("file"), buckets))
    _put(path, "wanted", n, hopes, gone)
    again_resolved(before, gone, now.table("paths")).write.mode("overwrite").parquet(f"{path}/wanted/again/segment={n}")
    again = spark.read.parquet(f"{path}/wanted/again/segment={n}")
    nodes, edges = _with(code.own_graph(changed, project), more)
    _put(path, "nodes", n, nodes, gone)
    new_wanted = spark.read.schema(WANTED).parquet(f"{path}/wanted/rows/segment={n}")
    edges = edges.unionByName(code.cross_edges(new_wanted, now.table("paths"), project))
    _put(path, "edges", n, *_edges_after(before, now, edges, gone, again))
    return now


def again_resolved(before: GraphIndex, gone: DataFrame, paths: DataFrame) -> DataFrame:
    """(path): unchanged files with a reference to a path that came or went; of `wanted` only the buckets of those paths are read."""
    there = before.table("paths").join(bounded(gone), "path", "left_semi")
    came, went = gone.join(there, "path", "left_anti"), there.join(paths.join(bounded(gone), "path", "left_semi"), "path", "left_anti")
    moved = came.union(went).select(F.col("path").alias("file")).withColumn("bucket", _bucket(F.col("file"), before.buckets))
    place = f"{before.path}/wanted/moved/segment={before.segment + 1}"
    moved.write.mode("overwrite").parquet(place)
    moved = before.spark.read.parquet(place)
    at = [r.bucket for r in moved.select("bucket").distinct().collect()]  # BUCKETS at most
    found = before.table("wanted").filter(F.col("bucket").isin(at)).join(bounded(moved.select("file")), "file", "left_semi")
    return found.select("path").distinct().join(bounded(gone), "path", "left_anti")


def _edges_after(before: GraphIndex, now: GraphIndex, new: DataFrame, gone: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges to write, ids to remove): those of changed files, those of files resolved again, and those whose end came or went."""
    there = now.table("nodes").select(F.col("id").alias("dst")).distinct()
    edges, again = before.table("edges"), bounded(again)
    own, others = edges.join(bounded(gone), "path", "left_semi"), edges.join(bounded(gone), "path", "left_anti")
    crossing = F.col("kind").isin(*code.CROSS)
    redone = others.filter(crossing).join(again, "path", "left_semi")
    rest = others.filter(~crossing).unionByName(others.filter(crossing).join(again, "path", "left_anti"))
    found = code.cross_edges(now.table("wanted").join(again, "path", "left_semi"), now.table("paths"), now.project).select(*new.columns)
    ended = redone.join(found.select("id"), "id", "left_anti").join(there, "dst", "left_anti").withColumn("stale", F.lit(True))
    moved = before.table("nodes").join(bounded(gone), "path", "left_semi").select(F.col("id").alias("dst")).distinct()  # ends that may have gone
    lost = rest.filter(~F.col("stale")).join(moved, "dst", "left_semi").join(there, "dst", "left_anti").withColumn("stale", F.lit(True))
    back = rest.filter("stale").join(there, "dst", "left_semi").withColumn("stale", F.lit(False))
    turned = lost.unionByName(back).select(*new.columns)
    written = new.unionByName(found).unionByName(ended.select(*new.columns)).unionByName(turned)
    return written, own.select("id").unionByName(redone.select("id")).unionByName(turned.select("id"))


def copied(before: GraphIndex, path: str) -> GraphIndex:
    """The same graph under another path, as one segment."""
    for name in KEYS:
        rows = before.table(name)
        _put(path, name, 0, rows, rows.select(KEYS[name]).limit(0))
    before.spark.read.parquet(f"{before.path}/wanted/layout").write.mode("overwrite").parquet(f"{path}/wanted/layout")
    return GraphIndex(before.spark, path, 0, before.project)


def unchanged(before: GraphIndex) -> GraphIndex:
    """A segment without a change."""
    for name in KEYS:
        rows = before.table(name).limit(0)
        _put(before.path, name, before.segment + 1, rows, rows.select(KEYS[name]))
    return GraphIndex(before.spark, before.path, before.segment + 1, before.project)
