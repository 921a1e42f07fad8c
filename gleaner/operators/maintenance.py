"""Choices and labels of maintenance and evaluation: ignore files, resources, degradation, cases, provenance."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.joins import top
from gleaner.sources.files import IgnoreRules

#: Rows of a page of resources by default and at most.
PAGE, MOST_PAGE = 100, 1000
#: Labels of a degraded graph: by status, and by the code of a warning.
BY_STATUS = {"empty": "empty_graph", "stale": "stale_graph", "partial": "partial_graph", "unavailable": "unavailable_graph", "incompatible": "incompatible_graph", "failed": "failed_graph"}
BY_WARNING = {
    "graph_stale": "stale_graph", "extractor_partial": "partial_graph", "extractor_failed": "partial_graph", "build_failed": "failed_graph", "graph_unavailable": "unavailable_graph",
    "schema_incompatible": "incompatible_graph", "graph_stale_edges": "stale_edges", "graph_results_truncated": "result_truncated", "traversal_budget_exhausted": "traversal_budget_exhausted",
    "unsupported_language": "unsupported_language",
}
#: Labels that always block, and those whose status decides.
ALWAYS_BLOCKING, STATUS_LABELS = ("invalid_params", "unsupported_language"), tuple(BY_STATUS.values())
#: What can be done about a label.
RECOVERY = {
    "empty_graph": "recoverable", "stale_graph": "recoverable", "partial_graph": "recoverable after extractor/build fix", "unavailable_graph": "environment/config dependent", "incompatible_graph": "recoverable by rebuild or migration",
    "failed_graph": "recoverable after build fix", "stale_edges": "recoverable", "unsupported_language": "query targets a language without graph extractor support", "result_truncated": "query/corpus tunable",
    "traversal_budget_exhausted": "query/corpus tunable", "invalid_params": "corpus/config authoring failure",
}
SUPPORTED = ("go", "typescript", "javascript", "python", "markdown", "yaml", "json", "toml", "text")
WINDOW = 10


def ignore_diff(old: str, new: str) -> tuple[list[str], list[str]]:
    """(patterns added, patterns removed) between two versions of an ignore file; comments and blank lines don't count."""
    read = lambda text: [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    was, now = read(old), read(new)
    return [x for x in dict.fromkeys(now) if x not in was], [x for x in dict.fromkeys(was) if x not in now]


def ignore_strategy(path: str, old: str | None, new: str) -> str:
    """How to reconcile an index after an ignore file changed: none, subtree (a nested file), diff, or full (no old version, or exceptions)."""
    if "/" in path.strip("/"):
        return "subtree"
    if old is None:
        return "full"
    added, removed = ignore_diff(old, new)
    if not added and not removed:
        return "none"
    return "full" if any(x.startswith("!") for x in added + removed) else "diff"


def reconciled(indexed: DataFrame, present: DataFrame, path: str, old: str | None, new: str) -> tuple[DataFrame, DataFrame]:
    """(paths to remove from the index, paths to add to it) after an ignore file at `path` changed; tables of one column path."""
    base = path.rpartition("/")[0]
    rules = IgnoreRules(new.splitlines(), base)
    within = F.col("path").startswith(f"{base}/") if base else F.lit(True)
    how = ignore_strategy(path, old, new)
    if how == "none":
        return indexed.select("path").limit(0), present.select("path").limit(0)
    gone, come = indexed.filter(within & rules.ignored(F.col("path"))).select("path"), present.filter(within & ~rules.ignored(F.col("path")))
    if how == "diff":  # only what an added or a removed pattern matches can have changed
        added, removed = ignore_diff(old or "", new)
        gone = gone.filter(IgnoreRules(added, base).ignored(F.col("path")))
        come = come.filter(IgnoreRules(removed, base).ignored(F.col("path")))
    return gone, come.select("path").join(indexed.select("path"), "path", "left_anti")


def cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(f"offset:{offset}".encode()).decode()


def page_of(resources: DataFrame, at: str = "", limit: int = PAGE, order: str = "path") -> tuple[DataFrame, str]:
    """(a page of resources in order, cursor of the next one, empty at the end). One row more than the page tells whether there is more."""
    n = max(1, min(MOST_PAGE, limit or PAGE))
    offset = int(base64.urlsafe_b64decode(at.encode()).decode().removeprefix("offset:")) if at else 0
    if offset < 0:
        raise ValueError("a cursor can't be negative")
    rows = resources.orderBy(order).offset(offset).limit(n + 1)
    return rows.orderBy(order).limit(n), cursor(offset + n) if rows.count() > n else ""


def safe_path(path: str) -> str:
    """A resource's path within the project; anything that leads out of it is refused."""
    parts = path.replace("\\", "/").split("/")
    if not path or path.startswith(("/", "~")) or "\0" in path or ".." in parts or (len(path) > 1 and path[1] == ":"):
        raise ValueError(f"path leads out of the project: {path!r}")
    return "/".join(x for x in parts if x not in ("", "."))


def response_tokens(df: DataFrame, *columns: str) -> Column:
    """Four bytes of JSON a token, rounded up."""
    return F.ceil(F.octet_length(F.to_json(F.struct(*columns))) / 4).cast("long")


def degradation(status: Column, warnings: Column, stale_results: Column, language: Column, invalid: Column, transport_error: Column, results_exhausted: Column) -> Column:
    """Labels of a degraded answer, sorted; warnings: array of codes, results_exhausted: whether the budget that ran out was that of results."""
    from_status = F.create_map(*[F.lit(x) for kv in BY_STATUS.items() for x in kv])[status]
    from_codes = F.transform(warnings, lambda w: F.create_map(*[F.lit(x) for kv in BY_WARNING.items() for x in kv])[w])
    lang = F.lower(F.trim(language))
    more = F.array(
        from_status, F.when(stale_results, "stale_edges"), F.when((lang != "") & ~lang.isin(*SUPPORTED), "unsupported_language"), F.when(invalid, "invalid_params"),
        F.when(F.array_contains(warnings, "traversal_budget_exhausted") & results_exhausted, "result_truncated"), F.when(transport_error & (F.coalesce(status, F.lit("")) == "") & ~invalid, "unavailable_graph"),
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(from_codes, more))))


def blocking(labels: Column, expected: Column, status: Column, blocking_statuses: Column, include_stale: Column, results: Column, results_exhausted: Column) -> Column:
    """Labels that count against a case: not those it expects, not stale edges it asked for, truncation only within the ranked window."""
    short = results < WINDOW
    counts = lambda x: (
        F.when(x.isin(*STATUS_LABELS), F.array_contains(blocking_statuses, status)).when(x == "stale_edges", ~include_stale).when(x == "result_truncated", short)
        .when(x == "traversal_budget_exhausted", results_exhausted & short).otherwise(F.lit(True))
    )
    return F.filter(labels, lambda x: ~F.array_contains(expected, x) & F.coalesce(counts(x), F.lit(False)))


def negative_passes(found: Column, least: Column, most: Column, wanted_state: Column, state: Column, candidates: Column, least_candidates: Column, wanted_codes: Column, codes: Column, forbidden: Column, evidence: Column) -> Column:
    """Whether a negative case holds: results within bounds, resolved as wanted, with candidates and warnings, and no forbidden evidence."""
    in_bounds = (found >= F.coalesce(least, F.lit(0))) & (most.isNull() | (found <= most))
    resolved = wanted_state.isNull() | (wanted_state == state)
    return in_bounds & resolved & (candidates >= F.coalesce(least_candidates, F.lit(0))) & (F.size(F.array_except(wanted_codes, codes)) == 0) & (F.size(F.array_intersect(forbidden, evidence)) == 0)


def subset(cases: DataFrame, selection: str, quick: int = 15) -> DataFrame:
    """Cases (id, class, job, section, holdout) of a selection: full, holdout, graph, class:X, job:X, or quick: the first of each class, filled up."""
    kind, _, value = selection.partition(":")
    if kind == "full":
        return cases
    if kind == "holdout":
        return cases.filter("holdout")
    if kind == "graph":
        return cases.filter("section = 'graph'")
    if kind in ("class", "job") and value:
        return cases.filter(F.col(kind) == value)
    if kind != "quick":
        raise ValueError(f"unknown selection {selection!r}")
    numbered = top(cases, 2**31 - 1, ["class"], F.col("id"), rank="of_class")
    return numbered.orderBy(F.col("of_class") > 1, "id").limit(quick).drop("of_class")


def provenance(results: DataFrame, kind: str = "kind", title: str = "title") -> DataFrame:
    """One row for each query: chunks by syntax and by lines, the rate of the latter, and the quality of search this amounts to."""
    by_lines = (F.col(kind) == "text") | F.col(title).rlike(r"_part\d+$") | (F.col(title) == "")
    n = results.groupBy("query").agg(F.count("*").alias("chunks"), F.count_if(by_lines).alias("by_lines"))
    rate = F.round(F.col("by_lines") / F.col("chunks"), 6)
    return n.select("query", "chunks", "by_lines", rate.alias("line_rate"), F.when(rate == 0, "full").when(rate < 0.5, "mixed").otherwise("degraded").alias("quality"))
