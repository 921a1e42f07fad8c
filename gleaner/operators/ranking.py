"""Rank fusion and re-scoring of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import any_of, is_lexical, is_test_path

#: Weights of keyword and vector search: as the engine's default, and as its shipped configuration.
WEIGHTS = {"engine": (0.35, 0.65), "config": (0.65, 0.35)}
K = 60
TEST_PENALTY, IMPL_BOOST, WRAPPER_PENALTY, AUTHORITY_SCALE = 0.5, 1.3, 0.6, 0.12
EXACT_PATH, EXACT_SYMBOL, WRONG_KIND, QUOTED_CONTENT = 4.0, 4.0, 0.2, 1.2


def fuse(keyword: DataFrame, vector: DataFrame, weights: tuple[float, float] = WEIGHTS["engine"], k: int = K) -> DataFrame:
    """(query, id, rrf, keyword_rank, vector_rank, in_both, keyword_score, rank) of two rankings (query, id, score, rank).

    A side that lacks a document counts as one rank beyond the longer list; scores are divided by the query's best.
    """
    a = keyword.select("query", "id", F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score"))
    b = vector.select("query", "id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    both = a.join(b, ["query", "id"], "full_outer")
    of_query = Window.partitionBy("query")
    missing = F.greatest(F.count("keyword_rank").over(of_query), F.count("vector_rank").over(of_query)) + 1
    raw = weights[0] / (k + F.coalesce("keyword_rank", missing)) + weights[1] / (k + F.coalesce("vector_rank", missing))
    scored = both.withColumn("raw", raw).withColumn("rrf", F.round(F.col("raw") / F.max("raw").over(of_query), 6))
    scored = scored.withColumn("in_both", F.col("keyword_rank").isNotNull() & F.col("vector_rank").isNotNull())
    order = Window.partitionBy("query").orderBy(F.col("rrf").desc(), F.col("in_both").desc(), F.coalesce("keyword_score", F.lit(0.0)).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).drop("raw")


def fuse_plain(keyword: DataFrame, vector: DataFrame, weights: tuple[float, float] = WEIGHTS["engine"], k: int = K) -> DataFrame:
    """(query, id, rrf, rank): a side that lacks a document adds nothing; scores aren't normalised."""
    parts = keyword.select("query", "id", (weights[0] / (k + F.col("rank"))).alias("p")).unionByName(vector.select("query", "id", (weights[1] / (k + F.col("rank"))).alias("p")))
    s = parts.groupBy("query", "id").agg(F.round(F.sum("p"), 8).alias("rrf"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("rrf").desc(), "id")).cast("long"))


def fuse_many(results: DataFrame, k: int = K, consensus: float = 0.1) -> DataFrame:
    """(query, id, rrf, hits, rank) of sub-query rankings (query, sub, weight, id, rank); more hits raise the score."""
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    s = results.groupBy("query", "id").agg(F.sum(weight / (k + F.col("rank"))).alias("raw"), F.count("*").alias("hits"))
    s = s.withColumn("raw", F.col("raw") * (1 + consensus * (F.col("hits") - 1)))
    s = s.withColumn("rrf", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy("query")), 6)).drop("raw")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("rrf").desc(), F.col("hits").desc(), "id")).cast("long"))


def candidate_depth(q: Column, limit: int, filtered: bool = False) -> Column:
    """Candidates that a query fetches from each ranking: twice the limit, and more where filters or an exact query need them; none for an empty one."""
    wide = max(50, 10 * limit)
    return F.when(F.trim(q) == "", 0).when(is_lexical(q) | F.lit(filtered), wide).otherwise(2 * limit)


def path_factor(path: Column) -> Column:
    """Product of test penalty, implementation boost and wrapper penalty."""
    impl, wrapper = (any_of(path.startswith(f"{d}/"), F.contains(path, F.lit(f"/{d}/"))) for d in ("internal", "cmd"))
    one = F.lit(1.0)
    return F.when(is_test_path(path), TEST_PENALTY).otherwise(one) * F.when(impl, IMPL_BOOST).otherwise(one) * F.when(wrapper, WRAPPER_PENALTY).otherwise(one)


def exact_factor(path: Column, content: Column, symbols: Column, needle: Column, quoted: Column, kind: Column | None = None, declared: Column | None = None) -> Column:
    """The first case that fits: exact path, exact symbol, quoted phrase within the content.

    declared: kinds of symbol that the query declares (`type Name struct`); a symbol of another kind is held back then.
    """
    named = F.array_contains(symbols, needle)
    right = F.lit(True) if declared is None else declared.isNull() | F.coalesce(F.array_contains(declared, kind), F.lit(False))
    return F.when(path == needle, EXACT_PATH).when(named & right, EXACT_SYMBOL).when(named, WRONG_KIND).when(quoted & F.contains(content, needle), QUOTED_CONTENT).otherwise(1.0)


def authority_key(score: Column, priority: Column) -> Column:
    """Order by authority without changing the score that is shown."""
    return score + priority / 100.0 * AUTHORITY_SCALE
