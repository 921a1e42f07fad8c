"""What is shown of results: identifiers, snippets, highlights, explanations, roles; reports and their baselines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import confidence_label

SNIPPET, HIGHLIGHTS = 160, 10
#: Role of a node in a context pack, by the kinds of edges that lead to it.
CONTEXT_ROLES = (("caller", "symbol_calls"), ("importer", "file_imports"), ("test", "test_covers_implementation"), ("documentation", "doc_mentions_file"), ("definition", "file_defines_symbol"), ("setting", "file_defines_config_key"), ("place", "lives_in"), ("buyer", "ordered_by"))


def query_tokens(q: Column) -> Column:
    """Tokens of a query: runs of letters, digits and underscores, cut at underscores and before every capital, lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(q, r"([^A-Z_\W])([A-Z])|([A-Z])(?=[A-Z])", "$1$3 $2")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def result_id(*parts: Column) -> Column:
    return F.concat(F.lit("sr1_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def snippet(text: Column, n: int = SNIPPET) -> Column:
    return F.substring(F.trim(text), 1, n)


def match_reason(in_both: Column, keyword_rank: Column) -> Column:
    return F.when(in_both, "keyword and semantic match").when(keyword_rank > 0, "keyword match").otherwise("semantic match")


def highlight_spans(text: Column, terms: Column) -> Column:
    """Non-overlapping places of each term, HIGHLIGHTS a term at most, in order; case doesn't count."""

    def one(t, words):
        low, out = (t or "").lower(), []
        for w in dict.fromkeys(x.lower() for x in (words if words is not None else []) if x):
            at, n = low.find(w), 0
            while at >= 0 and n < HIGHLIGHTS:
                out.append((at, at + len(w)))
                at, n = low.find(w, at + len(w)), n + 1
        return [{"start": a, "end": b} for a, b in sorted(out)]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(t: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(t, w, strict=True)])

    return spans(text, terms)


def path_text(path: Column, kinds: Column) -> Column:
    """a -[kind]-> b -[kind]-> c for an array of nodes and one of kinds."""
    return F.concat(path[0], F.array_join(F.transform(kinds, lambda k, i: F.concat(F.lit(" -["), k, F.lit("]-> "), F.get(path, i + 1))), ""))


def roles(kinds: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.array_contains(kinds, k), r) for r, k in CONTEXT_ROLES]))


def weakest_label(confidence: Column) -> Column:
    return confidence_label(confidence)


def recall_gate(lift: Column) -> Column:
    """What a class's gain in recall (percentage points) says about a feature."""
    return F.when(lift >= 15, "keep").when(lift >= 10, "tune").when(lift >= 0, "defer").otherwise("kill")


def merged_profiles(profiles: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Profiles of one name merged field by field, as unions that keep first-seen order (rows in order of `pos`)."""
    rows = profiles.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("r"))  # a few rows a name
    field = lambda f: lambda x: x[f]
    return rows.select(key, *[F.array_distinct(F.flatten(F.transform("r", field(f)))).alias(f) for f in fields])


def bench_lines(lines: DataFrame, text: str, order: str) -> DataFrame:
    """(name, ns): results of a benchmark log; of repeats the last counts."""
    name, ns = F.regexp_extract(text, r"^(Benchmark\S*?)(?:-\d+)?\s+\d+\s+[\d.]+ ns/op", 1), F.regexp_extract(text, r"\s([\d.]+) ns/op", 1)
    found = lines.select(name.alias("name"), ns.try_cast("double").alias("ns"), F.col(order).alias("o")).filter("name <> ''")
    return found.groupBy("name").agg(F.max_by("ns", "o").alias("ns"))


def log_lines(lines: DataFrame, pattern: str | None = None, levels: tuple[str, ...] = (), text: str = "line", level: str = "level") -> DataFrame:
    """Lines of the levels asked for that a regular expression finds; works on streams, which follow a log, as on tables."""
    if levels:
        lines = lines.filter(F.col(level).isin(*levels))
    return lines.filter(F.col(text).rlike(pattern)) if pattern else lines


def write_report(df: DataFrame, path: str, replace: bool = False) -> None:
    """A report or baseline as JSON lines; one that exists is only replaced on demand."""
    df.coalesce(1).write.mode("overwrite" if replace else "errorifexists").json(path)


def put_vectors(old: DataFrame, new: DataFrame, removed: DataFrame, dims: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vectors, refused): rows replaced by id and unit length, removed ids gone; vectors of another dimension are refused."""
    from gleaner.operators.vectors import unit_vector

    ok = F.size(vec_col) == dims
    fresh = new.filter(ok).select(id_col, unit_vector(F.col(vec_col)).alias(vec_col))
    gone = fresh.select(id_col).unionByName(removed.select(id_col)).distinct()
    return old.select(id_col, unit_vector(F.col(vec_col)).alias(vec_col)).join(gone, id_col, "left_anti").unionByName(fresh.join(removed, id_col, "left_anti")), new.filter(~F.coalesce(ok, F.lit(False)))
