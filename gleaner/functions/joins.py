"""Join helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 50_000


def bounded(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Marked for broadcast if the rows of `counted` stay within the bound; else the join shuffles.

    `counted` (by default df itself) is a table that is cheap to count and has as many rows as df at least.
    """
    there = (df if counted is None else counted).limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if there <= BROADCAST_ROWS else df


def top(df: DataFrame, k: int, by: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group and their rank; the limit is pushed below the shuffle by the optimizer."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def spread(df: DataFrame, rows: int, *keys: str, each: int = 2_000_000) -> DataFrame:
    """Dealt out by the keys: as the session is configured, or to more tasks if that few would hold over `each` of the rows on average."""
    tasks = rows // each
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def within(df: DataFrame, on: str, keys: DataFrame) -> DataFrame:
    """The rows whose `on` lies between the least and the greatest of the keys (one column); others can't equal any of them."""
    (key,) = keys.columns
    least, most = keys.agg(F.min(key), F.max(key)).first()
    return df.filter(F.lit(False) if least is None else F.col(on).between(F.lit(least), F.lit(most)))


def sifted(df: DataFrame, on: str, keys: DataFrame) -> DataFrame:
    """The rows whose `on` may be among the keys (one column): by their range and a bitmap of fixed size, 8 million bits in at most
    2^17 broadcast words. What is left still needs the exact join."""

    def place(c: str) -> tuple[Column, Column]:
        h = F.xxhash64(c)
        return h.bitwiseAND(F.lit((1 << 17) - 1)), F.shiftright(h, 17).bitwiseAND(F.lit(63)).cast("int")

    (key,) = keys.columns
    word, bit = place(key)
    words = keys.filter(F.col(key).isNotNull()).select(word.alias("__word"), F.call_function("shiftleft", F.expr("1L"), bit).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    word, bit = place(on)
    marked = within(df, on, keys).withColumn("__word", word).join(F.broadcast(words), "__word")
    return marked.filter(F.call_function("shiftrightunsigned", F.col("__bits"), bit).bitwiseAND(F.expr("1L")) == 1).select(*df.columns)
