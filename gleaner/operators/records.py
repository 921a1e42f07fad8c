"""Records within texts, and operators that are sequential by nature: bounded memories and greedy choices."""

from __future__ import annotations

import json
from collections import OrderedDict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a decision record can stand.
STATUSES = ("proposed", "accepted", "implemented", "deprecated", "superseded", "rejected")
#: Queries whose hashes are remembered, embeddings compared with, and the likeness that counts as similar.
REMEMBERED, RECENT, SIMILAR = 500, 10, 0.95


def decision(content: Column) -> Column:
    """struct(status, supersedes, superseded_by) of a decision record; a record that another supersedes is superseded."""
    raw = F.lower(F.regexp_extract(content, r"(?im)^(?:[-*]\s*)?\**status\**\s*:\s*\**\s*([a-z]+)", 1))
    refs = lambda field: F.array_distinct(F.transform(F.regexp_extract_all(F.array_join(F.regexp_extract_all(content, F.lit(rf"(?im)^(?:[-*]\s*)?\**{field}\**\s*:\s*(.*)$"), F.lit(1)), " "), F.lit(r"(?i)\b(ADR-\d+)\b"), F.lit(1)), F.upper))
    by = refs(r"superseded[ -]by")
    by = F.when(F.size(by) > 0, by).otherwise(F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(r"(?im)^.*status.*superseded\s+by\s+(ADR-\d+)"), F.lit(1)), F.upper)))
    status = F.when(F.size(by) > 0, "superseded").when(raw.isin(*STATUSES), raw).otherwise("unknown")
    return F.struct(status.alias("status"), refs("supersedes").alias("supersedes"), by.alias("superseded_by"))


def front_matter(content: Column) -> Column:
    """map of `fm.<key>` to the scalar values of a leading front-matter block; null without one."""
    block = F.regexp_extract(content, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    pairs = F.filter(F.transform(F.split(block, "\n"), lambda l: F.struct(F.concat(F.lit("fm."), F.regexp_extract(l, r"^([A-Za-z_][\w-]*)\s*:", 1)).alias("k"), F.trim(F.regexp_extract(l, r"^[A-Za-z_][\w-]*\s*:\s*[\"']?(.*?)[\"']?\s*$", 1)).alias("v"))), lambda p: (p["k"] != "fm.") & (p["v"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.when(block != "", F.map_from_entries(last))


def path_references(content: Column, roots: tuple[str, ...] = ("internal", "cmd", "pkg", "docs", "configs")) -> Column:
    """Paths under known roots that a text names, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(rf"(?:^|[\s`'\"(\[<])((?:{'|'.join(roots)})/[\w./-]*\w)"), F.lit(1)))


def reranker_policy(kind: Column, policy: str = "auto") -> Column:
    """struct(apply, reason): whether a query of a class is worth a reranker."""
    made = lambda a, r: F.struct(F.lit(a).alias("apply"), F.lit(r).alias("reason"))
    if policy in ("always", "never"):
        return made(policy == "always", f"policy_{policy}")
    return F.when(kind == "SEMANTIC", made(True, "semantic")).when(kind == "LEXICAL", made(False, "lexical")).otherwise(made(False, "unknown_class"))


def submodules(text: str) -> list[dict[str, str]]:
    """name, path, url and branch of each section of a submodule file that has a path."""
    found: list[dict[str, str]] = []
    for line in map(str.strip, text.splitlines()):
        if line.startswith("[submodule"):
            found.append({"name": line.partition('"')[2].partition('"')[0]})
        elif "=" in line and found and not line.startswith("#"):
            key, _, value = line.partition("=")
            if key.strip() in ("path", "url", "branch"):
                found[-1][key.strip()] = value.strip()
    return [s for s in found if s.get("path")]


def load_cases(path: str) -> list[dict]:
    """Evaluation cases from a JSON file (or YAML, where a parser is installed) of {section: [case]}; each needs an id of its own, a query and expectations."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            loaded = yaml.safe_load(f)
        else:
            loaded = json.load(f)
    cases = [c | {"section": s} for s, cs in loaded.items() for c in cs]
    seen: set[str] = set()
    for c in cases:
        if not c.get("id") or c["id"] in seen:
            raise ValueError(f"case id missing or repeated: {c.get('id')!r}")
        if not c.get("query") or (c["section"] != "negative" and not c.get("expected")):
            raise ValueError(f"case {c['id']}: query or expectations missing")
        if any(not 0 <= e.get("grade", 2) <= 3 for e in c.get("expected", [])):
            raise ValueError(f"case {c['id']}: grades run from 0 to 3")
        seen.add(c["id"])
    return cases


class Memory:
    """What telemetry remembers of a user: the last REMEMBERED distinct query hashes (least recent out), and how many were repeats."""

    def __init__(self, hashes: list[str] | None = None, n: int = 0, repeats: int = 0, capacity: int = REMEMBERED):
        self.hashes, self.n, self.repeats, self.capacity = OrderedDict.fromkeys(hashes or []), n, repeats, capacity

    def see(self, h: str) -> None:
        self.n += 1
        if h in self.hashes:
            self.repeats += 1
            self.hashes.move_to_end(h)
            return
        self.hashes[h] = None
        if len(self.hashes) > self.capacity:
            self.hashes.popitem(last=False)


def repeat_stream(events: DataFrame, user: str, query: str, order: str, capacity: int = REMEMBERED) -> DataFrame:
    """(user, n, repeats) after each micro-batch: bounded state for each user, kept by the engine across batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    plain = events.select(F.col(user).alias("user"), F.sha2(F.col(query), 256).alias("h"), F.col(order).alias("o"))
    kind = plain.schema["user"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Memory(list(state.get[0]), state.get[1], state.get[2], capacity) if state.exists else Memory(capacity=capacity)
        for h in pd.concat(list(batches)).sort_values(["o", "h"])["h"]:
            m.see(h)
        state.update((list(m.hashes), m.n, m.repeats))
        yield pd.DataFrame({"user": [key[0]], "n": [m.n], "repeats": [m.repeats]})

    return plain.groupBy("user").applyInPandasWithState(step, f"user {kind}, n long, repeats long", "hashes array<string>, n long, repeats long", "update", GroupStateTimeout.NoTimeout)


def similar_queries(queries: DataFrame, user: str, order: str, vector: str, recent: int = RECENT, least: float = SIMILAR) -> DataFrame:
    """(user, n, similar): queries like one of the user's last `recent`. A sorted pass with a ring; a user's rows stream through one task."""
    plain = queries.select(F.col(user).alias("user"), F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v"))
    kind = plain.schema["user"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ring, n, hits = None, deque(maxlen=recent), 0, 0
        for b in batches:
            for u, v in zip(b["user"], b["v"], strict=True):
                if now is not None and u != now:
                    yield pd.DataFrame({"user": [now], "n": [n], "similar": [hits]})
                    ring, n, hits = deque(maxlen=recent), 0, 0
                now, n = u, n + 1
                x = np.asarray(v)
                x = x / max(np.linalg.norm(x), 1e-12)
                hits += any(float(x @ y) > least for y in ring)
                ring.append(x)
        if now is not None:
            yield pd.DataFrame({"user": [now], "n": [n], "similar": [hits]})

    return plain.repartition("user").sortWithinPartitions("user", "o").mapInPandas(work, f"user {kind}, n long, similar long")


def greedy_intervals(spans: DataFrame, by: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Of overlapping spans of a key the longest first, greedily: each kept one excludes those that overlap it."""
    schema = spans.schema

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_n=pdf[start] - pdf[end]).sort_values(["_n", start, end], kind="stable")
        kept: list[int] = []
        for i, (a, b) in zip(pdf.index, zip(pdf[start], pdf[end], strict=True), strict=True):
            if all(b < pdf.at[k, start] or a > pdf.at[k, end] for k in kept):
                kept.append(i)
        return pdf.loc[kept].drop(columns="_n")

    return spans.groupBy(*by).applyInPandas(keep, schema)


def gain(grade: Column, rank: Column) -> Column:
    """Discounted gain of a result."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def ndcg(results: DataFrame, judgements: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg): results (query, path, rank) matched one to one, best grade first, with judgements (query, path prefix, grade)."""
    plain = results.filter(F.col("rank") <= k).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("r"))  # k rows at most
    both = judgements.groupBy("query").agg(F.collect_list(F.struct("path", "grade")).alias("j")).join(plain, "query", "left")

    @F.pandas_udf("double")
    def score(r: pd.Series, j: pd.Series) -> pd.Series:
        def one(got, want) -> float:
            left, total = sorted(((w["grade"], w["path"]) for w in want), reverse=True), 0.0
            best = sum((2**g - 1) / np.log2(i + 2) for i, (g, _) in enumerate(left[:k]))
            for x in got if got is not None else []:
                hit = next((w for w in left if x["path"] == w[1] or x["path"].startswith(w[1].rstrip("/") + "/")), None)
                if hit is not None:
                    left.remove(hit)
                    total += (2 ** hit[0] - 1) / np.log2(x["rank"] + 1)
            return total / best if best else 0.0

        return pd.Series([one(a, b) for a, b in zip(r, j, strict=True)])

    return both.select("query", F.round(score("r", "j"), 6).alias("ndcg"))
