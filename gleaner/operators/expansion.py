"""Query expansion for the keyword side of a search: further words for those of a query, from a table that callers may extend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import is_lexical, tokens

#: Words and what program text may say instead.
SYNONYMS = {
    "function": ("func", "method", "fn"), "method": ("func", "fn", "def"), "class": ("type", "struct", "interface"), "error": ("err", "exception", "fail"),
    "request": ("req", "http"), "response": ("resp", "reply"), "config": ("cfg", "configuration", "settings"), "context": ("ctx",), "retry": ("attempt", "backoff"),
    "the": ("a", "an"), "with": ("by", "using"), "of": ("from",),
}
#: Fixed value: words added for each word of a query, at most.
EACH = 3


def expanded(queries: DataFrame, id_col: str, text_col: str, synonyms: dict[str, tuple[str, ...]] | None = None, each: int = EACH) -> DataFrame:
    """(query, q): words once each in order, then up to `each` further ones a word; exact queries (names, paths, quotes, codes) stay as they are.

    The table of words is small and broadcast; queries are many. Case makes no further words, as the index folds it.
    """
    table = SYNONYMS if synonyms is None else synonyms
    plain = queries.select(F.col(id_col).alias("query"), F.col(text_col).alias("q"))
    words = plain.filter(~is_lexical(F.col("q"))).select("query", F.posexplode(tokens(F.col("q"))).alias("pos", "term"))
    first = words.groupBy("query", "term").agg((F.min("pos") + 1).alias("pos"))
    syn = queries.sparkSession.createDataFrame([(t, i, s) for t, ss in table.items() for i, s in enumerate(ss)], "term string, n int, syn string")
    more = first.join(F.broadcast(syn), "term").filter(F.col("n") < each).groupBy("query", F.col("syn").alias("term")).agg((F.min(F.col("pos") * 10 + F.col("n")) + 1000).alias("pos"))
    more = more.join(first, ["query", "term"], "left_anti")
    both = first.unionByName(more).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    told = both.select("query", F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("said"))
    return plain.join(told, "query", "left").select("query", F.coalesce("said", F.trim("q")).alias("q"))
