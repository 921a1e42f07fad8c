"""Results that ranking alone would miss: holders of an exact symbol, files that a decision names, PDF passages, paths of sub-queries.

Results are (query, id, score, …); chunks are (id, path, kind, title, start_line, content). Each kind of candidate is
appended at the score of the query's best result, or 1 without one, unless the results have it already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.joins import bounded, top
from gleaner.functions.text import DECISION_REF, FILE_PATH, IDENTIFIERS, NATURAL, QUOTED, any_of, is_lexical
from gleaner.operators.records import path_references

#: Rows looked at and kept for each kind of candidate.
SYMBOL_ROWS, ADR_DOCS, ADR_PATHS, ADR_CHUNKS, PDF_ROWS, PDF_KEPT, HINT_PATHS, HINT_CHUNKS = 10, 20, 12, 2, 48, 8, 8, 3
PDF_BOOST, PDF_STEP = 3.0, 0.05
#: English words that say nothing about a topic.
ENGLISH_STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can",
    "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under", "and", "or", "but", "if", "how",
)


def best_scores(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, best): the score that a candidate of a query gets."""
    best = results.groupBy("query").agg(F.max("score").alias("best"))
    return queries.select("query").join(best, "query", "left").select("query", F.when(F.col("best") > 0, F.col("best")).otherwise(1.0).alias("best"))


def append(results: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates (query, id[, factor]) that the results lack, with their score: (query, id, score)."""
    factor = F.col("factor") if "factor" in found.columns else F.lit(1.0)
    new = found.select("query", "id", factor.alias("factor")).groupBy("query", "id").agg(F.max("factor").alias("factor"))
    new = new.join(results.select("query", "id"), ["query", "id"], "left_anti").join(best_scores(results, queries), "query")
    return new.select("query", "id", (F.col("best") * F.col("factor")).alias("score"))


def needle(q: Column) -> Column:
    """struct(text, quoted): what an exact query asks for, else null. `type Name struct` asks for the name."""
    t = F.trim(q)
    declared = F.regexp_extract(t, r"(?i)^type\s+([A-Za-z_]\w*)\s+\w+$", 1)
    quoted = t.rlike(QUOTED) & (F.length(t) >= 2)
    return F.when(declared != "", F.struct(declared.alias("text"), F.lit(False).alias("quoted"))).when(is_lexical(q), F.struct(F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t).alias("text"), quoted.alias("quoted")))


def declared_kinds(q: Column) -> Column:
    """Kinds of symbol that `type Name struct` or `type Name interface` may mean; else null."""
    word = F.lower(F.regexp_extract(F.trim(q), r"(?i)^type\s+[A-Za-z_]\w*\s+(\w+)$", 1))
    return F.when(word == "struct", F.array(F.lit("type"), F.lit("class"))).when(word == "interface", F.array(F.lit("interface"), F.lit("type")))


def exact_symbols(queries: DataFrame, symbols: DataFrame, limit: int = SYMBOL_ROWS) -> DataFrame:
    """(query, id) of chunks that define the symbol a query names; symbols: (id, name, kind_rank, line), joined by equality."""
    n = needle(F.col("q"))
    wanted = queries.select("query", n.alias("n")).filter("n IS NOT NULL AND NOT n.quoted").filter(~F.col("n.text").rlike(r"[/\\]")).select("query", F.col("n.text").alias("name"))
    hit = symbols.join(bounded(wanted), "name")
    best = hit.groupBy("query", "id").agg(F.min("kind_rank").alias("kind_rank"), F.min("line").alias("line"))
    return top(best, max(limit, SYMBOL_ROWS), ["query"], F.col("kind_rank"), F.col("line"), F.col("id")).select("query", "id")


def decision_paths(queries: DataFrame, decisions: DataFrame) -> DataFrame:
    """(query, path, place): files that the decision records named in a query refer to, in order of their mention.

    decisions: (path, content) of records only; a record answers to a reference that its path or text holds.
    """
    ref = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("q", F.lit(rf"({DECISION_REF})"), F.lit(1)), F.upper)))
    refs = queries.filter(F.col("q").rlike(DECISION_REF)).select("query", ref.alias("ref"))
    own = F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws("\n", "path", "content"), F.lit(rf"({DECISION_REF})"), F.lit(1)), F.upper))
    docs = top(decisions.select("path", "content", F.explode(own).alias("ref")).join(bounded(refs), "ref"), ADR_DOCS, ["query", "ref"], F.col("path"), rank="doc")
    named = docs.select("query", "doc", F.posexplode(path_references(F.col("content"))).alias("pos", "path"))
    first = named.groupBy("query", "path").agg(F.min(F.struct("doc", "pos")).alias("at"))
    return top(first, ADR_PATHS, ["query"], F.col("at"), F.col("path"), rank="place").select("query", "path", "place")


def chunks_of_paths(paths: DataFrame, chunks: DataFrame, each: int) -> DataFrame:
    """(query, id): the first chunks of each path (query, path)."""
    hit = chunks.select("id", "path", "start_line").join(bounded(paths.select("query", "path").distinct()), "path")
    return top(hit, each, ["query", "path"], F.col("start_line"), F.col("id")).select("query", "id")


def wants_pdf(q: Column) -> Column:
    """A question in words that speaks of PDF and names no path or identifier."""
    words = F.filter(F.split(F.trim(q), r"\s+"), lambda w: F.lower(w) != "pdf")
    technical = F.exists(F.transform(words, lambda w: F.regexp_replace(w, r"""^["'.,:;()\[\]{}<>`]+|["'.,:;()\[\]{}<>`]+$""", "")), lambda w: any_of(*[w.rlike(p) for p in IDENTIFIERS]))
    return F.contains(F.lower(q), F.lit("pdf")) & F.trim(q).rlike(NATURAL) & ~q.rlike(r"[/\\]") & ~technical


def pdf_terms(q: Column) -> Column:
    """Words of a query that an overlap counts: three characters or more, no stop words, each once."""
    words = F.filter(F.split(F.lower(q), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*ENGLISH_STOP_WORDS) & ~w.isin("pdf", "what", "where", "which", "find", "show"))
    return F.array_distinct(words)


def pdf_overlap(terms: Column, path: Column, content: Column) -> Column:
    said = F.lower(F.concat_ws("\n", path, content))
    return F.size(F.filter(terms, lambda t: F.contains(said, t))).cast("long")


def pdf_passages(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, id, factor) of PDF passages that share words with a question about PDFs: the best few of the first ones by path."""
    few = chunks.filter(F.lower("path").endswith(".pdf")).orderBy("path", "start_line", "id").limit(PDF_ROWS)  # a stated number of rows
    asked = bounded(queries.filter(wants_pdf(F.col("q"))).select("query", pdf_terms(F.col("q")).alias("terms")))
    hit = few.select("id", "path", "start_line", "content").crossJoin(asked).withColumn("overlap", pdf_overlap(F.col("terms"), F.col("path"), F.col("content"))).filter("overlap > 0")
    kept = top(hit, PDF_KEPT, ["query"], F.col("overlap").desc(), F.col("path"), F.col("start_line"))
    return kept.select("query", "id", (1 + PDF_STEP * F.col("overlap")).alias("factor"))


def pdf_factor(q: Column, path: Column) -> Column:
    return F.when(wants_pdf(q) & F.lower(path).endswith(".pdf"), PDF_BOOST).otherwise(1.0)


def is_safe_hint(path: Column) -> Column:
    """A path that may be looked up because a sub-query names it: relative, within the project, with a known extension."""
    return path.rlike(FILE_PATH) & ~path.startswith("/") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~path.rlike(r"^[A-Za-z]:") & F.contains(path, F.lit("/"))


def hinted_paths(subs: DataFrame) -> DataFrame:
    """(query, path) that sub-queries (query, sub, text) are: the first few safe ones of each query."""
    named = subs.select("query", "sub", F.trim("text").alias("path")).filter(is_safe_hint(F.col("path"))).groupBy("query", "path").agg(F.min("sub").alias("sub"))
    return top(named, HINT_PATHS, ["query"], F.col("sub"), F.col("path")).select("query", "path")
