"""Sub-queries of a query, and their searches as one plan keyed by query and sub-query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.joins import top
from gleaner.functions.text import FILE_PATH, IDENTIFIERS, QUOTED, any_of
from gleaner.operators.candidates import ENGLISH_STOP_WORDS
from gleaner.operators.ranking import fuse_many

#: Sub-queries of a query at most, and the fewest results that each fetches.
MOST, LEAST_DEPTH = 8, 50
#: Patterns of the families that are decomposed.
NOUN_FUNCTION, HOW_WORKS = r"(?i)^(\w+)\s+(function|func|method)$", r"(?i)^how\s+does\s+(.+?)\s+work$"


def families(q: Column) -> Column:
    """noun, how, flow, impact or retry, the first that fits; null for a query that is searched as it is."""
    t, low = F.trim(q), F.lower(q)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    whole = (words <= 1) & any_of(*[t.rlike(p) for p in IDENTIFIERS]) | t.rlike(FILE_PATH) | t.rlike(QUOTED)
    flow = any_of(*[F.contains(low, F.lit(x)) for x in (" flows ", " flow ", " pipeline ")])
    impact = F.contains(low, F.lit("affected by changing")) | F.contains(low, F.lit("changes if"))
    retry = F.contains(low, F.lit("retry")) & any_of(*[F.contains(low, F.lit(x)) for x in ("error", "handling", "backoff")])
    return F.when(whole, None).when(t.rlike(NOUN_FUNCTION), "noun").when(t.rlike(HOW_WORKS), "how").when(flow, "flow").when(impact, "impact").when(retry, "retry")


def _row(text: Column, weight: float, hint: str = "") -> Column:
    return F.struct(text.alias("text"), F.lit(weight).alias("weight"), F.lit(hint).alias("hint"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"[^\w./-]+"), lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*ENGLISH_STOP_WORDS))


def sub_queries(queries: DataFrame, most: int = MOST) -> DataFrame:
    """(query, sub, text, weight, hint): at most `most` sub-queries of each query (query, q); itself if its family is none."""
    q = F.col("q")
    noun, topic = F.initcap(F.lower(F.regexp_extract(F.trim(q), NOUN_FUNCTION, 1))), F.regexp_extract(F.trim(q), HOW_WORKS, 1)
    low, lit = F.lower(noun), F.lit
    by_noun = F.array(
        _row(F.concat(lit(") "), noun, lit("(")), 1.5, "code"), _row(F.concat(noun, lit("(ctx")), 1.4, "code"), _row(F.concat(lit("func "), noun), 1.2, "code"), _row(F.concat(lit("func ("), low), 1.1, "code"),
        _row(F.concat(noun, lit(" method")), 1.0, "code"), _row(F.concat(noun, lit("(")), 0.9, "code"), _row(noun, 0.8, "code"),
    )
    each = F.flatten(F.transform(_words(topic), lambda w: F.when(F.length(w) >= 3, F.array(_row(w, 1.0), _row(F.concat(F.lower(w), lit(".go")), 1.1, "code"))).otherwise(F.array(_row(w, 1.0)))))
    by_how = F.concat(each, F.array(_row(F.concat(lit("func "), F.initcap(F.lower(F.element_at(F.split(F.trim(topic), r"\s+"), -1)))), 1.0, "code")))
    by_words = F.concat(F.array(_row(q, 1.0)), F.transform(_words(q), lambda w: _row(w, 0.7)))
    family = families(q)
    made = F.when(family == "noun", by_noun).when(family == "how", by_how).when(family.isNotNull(), by_words).otherwise(F.array(_row(q, 1.0)))
    rows = queries.filter(F.trim(q) != "").select("query", F.posexplode(made).alias("pos", "s"))
    first = rows.groupBy("query", "s").agg((F.min("pos") + 1).alias("at"))
    return top(first, most, ["query"], F.col("at"), rank="sub").select("query", F.col("sub").cast("int").alias("sub"), "s.*")


def found_by(subs: DataFrame, search: Callable[[DataFrame, int], DataFrame], limit: int) -> DataFrame:
    """(query, sub, weight, id, rank): all sub-queries in one search; one without results adds nothing.

    search: from (query, q) rows, here one for each sub-query, and a depth to (query, id, rank).
    """
    keyed = subs.withColumn("of", F.concat_ws("\x1f", F.col("query").cast("string"), F.col("sub").cast("string")))
    found = search(keyed.select(F.col("of").alias("query"), F.col("text").alias("q")), max(limit, LEAST_DEPTH))
    return found.select(F.col("query").alias("of"), "id", "rank").join(keyed.select("of", "query", "sub", "weight"), "of").select("query", "sub", "weight", "id", "rank")


def search_many(subs: DataFrame, search: Callable[[DataFrame, int], DataFrame], limit: int) -> DataFrame:
    """(query, id, rrf, hits, rank): the results of all sub-queries, fused for each query."""
    return fuse_many(found_by(subs, search, limit)).filter(F.col("rank") <= limit)
