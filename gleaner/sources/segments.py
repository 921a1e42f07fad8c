"""Tables that grow by segments: a change appends its rows and the keys it removes, and a reader sees the table as of a segment.

`rows/segment=n` holds rows, `gone/segment=n` the keys removed by change n: a row is there if no later change removed its
key. Nothing is rewritten, so a change costs what changes, and readers of an older segment aren't disturbed; `compact`
writes the table anew as one segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put(path: str, n: int, rows: DataFrame, gone: DataFrame | None = None, by: tuple[str, ...] = ()) -> None:
    """Write change n: its rows and the keys (a table of one column) that it removes. Writing it again replaces it."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(f"{path}/rows/segment={n}")
    if gone is not None:
        gone.distinct().write.mode("overwrite").parquet(f"{path}/gone/segment={n}")


def live(spark: SparkSession, path: str, key: str, upto: int, schema: str | None = None) -> DataFrame:
    """The rows as of change `upto`, with their segment. Only tables that were ever changed are joined with what is gone.

    schema: of the rows, for tables that may have none so far.
    """
    read = spark.read.schema(f"{schema}, segment int") if schema else spark.read
    rows = read.parquet(f"{path}/rows").filter(F.col("segment") <= upto)
    if upto == 0:
        return rows
    gone = spark.read.parquet(f"{path}/gone").filter(F.col("segment") <= upto).groupBy(key).agg(F.max("segment").alias("until"))
    return rows.join(gone, (rows[key] == gone[key]) & (rows["segment"] < gone["until"]), "left_anti")


def counts(spark: SparkSession, path: str, key: str, upto: int) -> DataFrame:
    """One row: rows there, rows stored, orphans (stored but gone) and their share."""
    stored = spark.read.parquet(f"{path}/rows").filter(F.col("segment") <= upto).agg(F.count("*").alias("stored"))
    there = live(spark, path, key, upto).agg(F.count("*").alias("rows"))
    both = there.crossJoin(stored)  # one row each
    orphans = F.col("stored") - F.col("rows")
    return both.select("rows", "stored", orphans.alias("orphans"), F.when(F.col("stored") > 0, orphans / F.col("stored")).otherwise(0.0).alias("share"))
