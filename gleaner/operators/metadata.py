"""Source metadata from paths and content: class, authority, profile, freshness and priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import any_of, glob_regex

#: Fixed values: (pattern, class, authority, profile, generated, stale); the first that fits decides.
RULES = (
    ("archive/**", "archived", "archived", "archive", False, True),
    ("**/*.log", "raw_evidence", "raw_evidence", "review_corpus", False, False),
    ("docs/reference/decisions/ADR-*.md", "adr", "unknown", "project_memory", False, False),
    (".gitignore", "config", "authoritative", "code", False, False),
    ("go.mod", "config", "authoritative", "code", False, False),
    ("Makefile", "config", "authoritative", "code", False, False),
    ("configs/**", "config", "active", "code", False, False),
    ("docs/**", "docs", "active", "project_memory", False, False),
    ("README.md", "docs", "active", "project_memory", False, False),
)
#: Profiles that a search may be confined to: globs to include (none: all), globs to leave out, classes, authorities that are left out.
PROFILES = {
    "code": (("internal/**", "cmd/**", "pkg/**", "configs/**", "app/**", "tests/**"), ("archive/**",), ("source_code", "test", "config"), ("archived", "raw_evidence")),
    "project_memory": (("docs/**", "README.md"), ("archive/**",), ("docs", "adr", "config", "unknown"), ("archived", "raw_evidence")),
    "review_corpus": ((), ("archive/**",), ("raw_evidence", "docs", "unknown"), ("archived",)),
    "archive": (("archive/**",), (), ("archived",), ()),
}
#: Without a profile these classes aren't searched.
DEFAULT_DENIED = ("archived", "raw_evidence")
#: What a decision's standing adds to its priority.
DECISION_PRIORITY = {"accepted": 15, "implemented": 15, "proposed": 0, "deprecated": -25, "superseded": -30, "rejected": -30}
#: Priority of each authority.
PRIORITY = {"authoritative": 100, "active": 80, "unknown": 45, "generated": 35, "advisory": 25, "raw_evidence": 20, "archived": 10}


def source_metadata(path: Column, rules=RULES) -> Column:
    """struct(class, authority, profile, generated, stale): path rules, then the kind of file."""
    made = lambda c, a, p, g, s: F.struct(F.lit(c).alias("source_class"), F.lit(a).alias("authority"), F.lit(p).alias("profile"), F.lit(g).alias("generated"), F.lit(s).alias("stale"))
    out = None
    for pattern, *values in rules:
        hit = path.rlike(glob_regex(pattern))
        out = F.when(hit, made(*values)) if out is None else out.when(hit, made(*values))
    test = any_of(path.rlike(r"_test\.(go|py)$"), path.rlike(r"(^|/)test_[^/]*\.py$"))
    out = out.when(test, made("test", "active", "code", False, False)).when(path.rlike(r"\.(go|ts|js|py)$"), made("source_code", "active", "code", False, False))
    return out.when(path.rlike(r"\.(md|pdf)$"), made("docs", "active", "project_memory", False, False)).otherwise(made("unknown", "unknown", "project_memory", False, False))


def priority(meta: Column, decision: Column | None = None) -> Column:
    """Priority by authority, less for generated and stale sources; decision: the standing of a decision record, if it is one."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[meta["authority"]], F.lit(45))
    base = base - F.when(meta["generated"], 10).otherwise(0) - F.when(meta["stale"], 20).otherwise(0)
    return base if decision is None else base + F.coalesce(F.create_map(*[F.lit(x) for kv in DECISION_PRIORITY.items() for x in kv])[decision], F.lit(0))


def eligible(path: Column, meta: Column, profile: str | None) -> Column:
    """Whether a profile's search may return a source; without a profile, archived and raw sources are left out."""
    if profile is None:
        return ~meta["source_class"].isin(*DEFAULT_DENIED)
    include, exclude, classes, denied = PROFILES[profile]
    fits = lambda globs: any_of(*[path.rlike(glob_regex(g)) for g in globs])
    ok = meta["source_class"].isin(*classes)
    if denied:
        ok &= ~meta["authority"].isin(*denied)
    return ok & (fits(include) if include else F.lit(True)) & (~fits(exclude) if exclude else F.lit(True))


def with_mismatches(rows: DataFrame, profile: str | None, path: str = "path", meta: str = "meta") -> tuple[DataFrame, DataFrame]:
    """(rows that a profile's search may return, the others with the reason they are left out)."""
    ok = eligible(F.col(path), F.col(meta), profile)
    reason = F.concat(F.lit("class "), F.col(meta)["source_class"], F.lit(", authority "), F.col(meta)["authority"])
    return rows.filter(ok), rows.filter(~ok).withColumn("reason", reason)


def decision_mode(meta: Column, content: Column, mode: str) -> Column:
    """history: decision records of any standing; current: those that are in force."""
    from gleaner.operators.records import decision

    is_record = meta["source_class"] == "adr"
    return is_record if mode == "history" else is_record & ~meta["stale"] & ~meta["generated"] & ~decision(content)["status"].isin("superseded", "deprecated", "rejected")


def scope_prefixes(rules=RULES, wanted: str = "adr") -> list[str]:
    """Folders that hold the sources of a class, from the fixed part of its patterns, without those within another."""
    found = {pattern.split("*")[0].rsplit("/", 1)[0] for pattern, source_class, *_ in rules if source_class == wanted and "/" in pattern.split("*")[0]}
    return sorted(p for p in found if not any(p != other and p.startswith(other + "/") for other in found))
