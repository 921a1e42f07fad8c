"""Exact nearest-rank quantiles without sorting or collecting a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, by: str, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """`by` and, for each name in `shares`, the value of rank ceil(n * share) among the group's non-null values.

    A sketch brackets each rank within n / accuracy values; the exact rank is then found among the rows of the bracket,
    so the one sort that is left sees a few ten-thousandths of a group. Counts below a bracket are plain aggregates.
    """
    d = df.select(F.col(by).alias("k"), F.col(value).alias("v")).filter("v is not null")
    slack = 2.0 / accuracy
    ends = [F.percentile_approx("v", [max(0.0, s - slack), min(1.0, s + slack)], accuracy).alias(n) for n, s in shares.items()]
    brackets = d.groupBy("k").agg(F.count("*").alias("n"), *ends)
    marked = d.join(brackets, "k")  # one row a group: broadcast by size, else shuffled
    found = []
    for name, share in shares.items():
        lo, hi = F.col(name)[0], F.col(name)[1]
        below = marked.groupBy("k").agg(F.count_if(F.col("v") < lo).alias("below"))
        inside = marked.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("k", "n", "v").agg(F.count("*").alias("c")).join(below, "k")
        upto = F.col("below") + F.sum("c").over(Window.partitionBy("k").orderBy("v"))
        at = F.ceil(F.col("n") * share)
        hit = inside.withColumn("upto", upto).filter((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at))
        found.append(hit.select("k", F.col("v").alias(name)))
    return reduce(lambda a, b: a.join(b, "k"), found).withColumnRenamed("k", by)
