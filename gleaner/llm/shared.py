"""Helpers of the training-data operators: shared-folder tables and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few fixed-size columns (about 2 MB).
BROADCAST_ROWS = 20_000

_at: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # where stored tables are


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local session gets a folder of its own, and a
    cluster an error, as a local folder there would scatter the tables over the executors."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='gleaner-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place for a table in the shared folder."""
    return f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and lost executors cost nothing.

    The table is deleted when the driver ends, or before by `drop`.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    place, files = _file_system(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _at[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that no result reads any more."""
    for df in tables:
        place, files = _file_system(df.sparkSession, _at.pop(df))
        files.delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """The same table, marked for broadcast only if its counted rows stay within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def let(value: Column, body) -> Column:
    """Bind an expression to a lambda variable, so that it is evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def unit(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the arguments only, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def look_up(left: DataFrame, right: DataFrame, on: str, weight: str, rows: int, share: int = 1000) -> DataFrame:
    """Inner join with a table of one row a key, where `weight` says how many rows of `left` a key has.

    Keys with over 1/share of the rows (so `share` keys at most) are broadcast; all others are joined by shuffle.
    """
    values, mark = [c for c in right.columns if c != on], fresh(left, "__hot")[0]
    hot = right.filter(F.col(weight) > max(1000, rows // share)).select(on, F.struct(*values).alias(mark))
    marked = left.join(F.broadcast(hot), on, "left")
    found = marked.filter(F.col(mark).isNotNull()).select(*left.columns, *[F.col(f"{mark}.{c}").alias(c) for c in values])
    return found.unionByName(marked.filter(F.col(mark).isNull()).select(*left.columns).join(right, on))


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn, each a grouped minimum and a join, until the edges are stars; every
    step is written to the shared folder, so a lost executor costs one step.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), name)
    seen = mark(now)
    while seen[0]:
        halfway = stored(large(now).distinct(), name)
        drop(now)
        now = stored(small(halfway).distinct(), name)
        drop(halfway)
        last, seen = seen, mark(now)
        if last == seen:
            break
    pairs = now.groupBy("a").agg(F.min("b").alias("b"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", F.col("b").alias("root")).distinct())


def parted(df: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose `on` may be among the keys, rows whose `on` is not): by a one-probe bitmap of fixed size, 8 million bits
    in at most 2^17 broadcast words. Only the first part then needs an exact join; a crowded bitmap puts all rows in it.
    """
    h = F.xxhash64(on)
    # not pmod, which may be null: the optimizer would test that by computing the key a second time
    word, bit = h.bitwiseAND(F.lit((1 << 17) - 1)), F.shiftright(h, 17).bitwiseAND(F.lit(63)).cast("int")
    at, bits = fresh(df, "__word", "__bits")
    words = keys.select(word.alias(at), F.call_function("shiftleft", F.expr("1L"), bit).alias("b")).groupBy(at).agg(F.bit_or("b").alias(bits))
    marked = df.withColumn(at, word).join(F.broadcast(words), at, "left")
    hit = F.call_function("shiftrightunsigned", F.coalesce(bits, F.lit(0).cast("long")), bit).bitwiseAND(F.expr("1L")) == 1
    own = [F.col(f"`{c}`") for c in df.columns]
    return marked.filter(hit).select(*own), marked.filter(~hit).select(*own)


def sift(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of `df` whose `on` may be among the keys; most others are dropped before the exact join shuffles."""
    return parted(df, keys, on)[0]
