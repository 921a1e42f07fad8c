"""Typed property graph as nodes(id, kind, key, name) and edges(id, kind, src, dst, confidence, heuristic, stale)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.joins import bounded, top

#: Role of the other end, seen from the source and from the target of an edge.
ROLES = {
    "file_imports": ("imported", "importer"), "file_defines_symbol": ("definition", "file"), "file_defines_config_key": ("setting", "file"), "test_covers_implementation": ("implementation", "test"),
    "doc_mentions_file": ("mentioned", "document"), "package_contains_file": ("member", "package"), "file_has_chunk": ("chunk", "file"), "contains": ("child", "parent"), "lives_in": ("home", "resident"), "ordered_by": ("buyer", "order"), "has_part": ("part", "used_in"), "supplied_by": ("supplier", "supplies"),
}


def node_id(kind: Column | str, key: Column, project: str = "shop") -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("node:"), kind, F.lit(f":{project}:"), key.cast("string"))


def edge_id(extractor: str, source: Column, kind: Column, src: Column, dst: Column, project: str = "shop") -> Column:
    return F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("|", F.lit(project), F.lit(extractor), source, kind, src, dst), 256), 1, 24))


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge for each relationship: highest confidence, then not heuristic, then smallest id; by a grouped maximum, not a sort."""
    order = F.struct((-F.col("confidence")).alias("c"), F.col("heuristic").alias("h"), F.col("id").alias("id"))
    best = edges.groupBy("src", "dst", "kind").agg(F.min_by(F.struct("id", "confidence", "heuristic", "stale"), order).alias("e"), F.count("*").alias("n"))
    return best.select("src", "dst", "kind", "e.*", (F.col("n") - 1).alias("suppressed"))


def related(edges: DataFrame, seeds: DataFrame, directions: tuple[str, ...] = ("out", "in")) -> DataFrame:
    """(seed, other, kind, role, direction, confidence): one hop from each seed."""
    parts = []
    for d, own, other, i in (("out", "src", "dst", 0), ("in", "dst", "src", 1)):
        if d in directions:
            role = F.create_map(*[F.lit(x) for k, v in ROLES.items() for x in (k, v[i])])[F.col("kind")]
            hit = edges.withColumnRenamed(own, "seed").join(seeds.select("seed"), "seed")
            parts.append(hit.select("seed", F.col(other).alias("other"), "kind", role.alias("role"), F.lit(d).alias("direction"), "confidence"))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def capped(rows: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    return top(rows, k, by, *order)


def within_budget(rows: DataFrame, budget: int, by: str, text: Column, *order: Column) -> DataFrame:
    """Rows until the running bytes pass the budget; the first row always stays."""
    w = Window.partitionBy(by).orderBy(*order)
    running = rows.withColumn("bytes", F.sum(F.octet_length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).withColumn("rank", F.row_number().over(w).cast("long"))
    return running.filter((F.col("bytes") <= budget) | (F.col("rank") == 1))


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within so many hops, each at its least depth; one join and one anti join a hop."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select(F.col("seed").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        frontier = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = frontier.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"))
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(path array, kinds array, weakest): loop-free paths of 1 to `depth` hops along edge direction."""
    e = edges.select("src", "dst", "kind", "confidence")
    now = seeds.select(F.array("seed").alias("path"), F.expr("cast(array() as array<string>)").alias("kinds"), F.lit(1.0).alias("weakest"), F.col("seed").alias("at"))
    found = None
    for _ in range(depth):
        now = now.join(e, now["at"] == e["src"]).filter(~F.array_contains("path", F.col("dst")))
        now = now.select(F.concat("path", F.array("dst")).alias("path"), F.concat("kinds", F.array("kind")).alias("kinds"), F.least("weakest", "confidence").alias("weakest"), F.col("dst").alias("at"))
        found = now if found is None else found.unionByName(now)
    return found.drop("at")


#: Tiers of a match by what is equal: key, path, name, id; 4 more if only the case differs, 10 and 11 for parts of name and id.
TIERS = (("key", 0), ("path", 1), ("name", 2), ("id", 3))
FOLDED, PART_OF_NAME, PART_OF_ID = 4, 10, 11
FILE_KINDS = ("file", "test_file", "doc", "config_file")
#: Subjects shown, hints shown, and the edits within which a name is a hint.
CANDIDATES, HINTS, EDITS = 10, 5, 3


def resolve(nodes: DataFrame, subjects: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(subject, id, score, state): the nodes of the least score of each subject; one is resolved, several are ambiguous.

    Equal forms are found by one equi-join on the form; only subjects that no node equals are looked for within names.
    nodes: (id, key, name[, path]).
    """
    tiers = [(c, t) for c, t in TIERS if c in nodes.columns]
    exact = [F.struct(F.col(c).cast("string").alias("form"), F.lit(t).alias("score")) for c, t in tiers]
    folded = [F.struct(F.concat(F.lit("\0"), F.lower(c)).alias("form"), F.lit(t + FOLDED).alias("score")) for c, t in tiers]
    forms = nodes.select("id", F.explode(F.array(*exact, *folded)).alias("f")).select("id", "f.*").filter("form IS NOT NULL")
    asked = subjects.select("subject").distinct()
    wanted = asked.select("subject", F.explode(F.array("subject", F.concat(F.lit("\0"), F.lower("subject")))).alias("form"))
    equal = forms.join(bounded(wanted), "form").groupBy("subject", "id").agg(F.min("score").alias("score"))
    rest = bounded(asked.join(equal.select("subject").distinct(), "subject", "left_anti"))
    within = _within(nodes, rest)
    hit = equal.unionByName(within)
    per = Window.partitionBy("subject")
    best = hit.withColumn("best", F.min("score").over(per)).filter(F.col("score") == F.col("best")).withColumn("n", F.count("*").over(per))
    return top(best, limit, ["subject"], F.col("id")).select("subject", "id", "score", F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("state"))


#: Characters of the pieces by which parts of names are looked up.
PIECE = 3


def _pieces(text: Column, n: int) -> Column:
    """The distinct stretches of n characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def _within(nodes: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, id, score): nodes whose name or id holds the subject, case aside.

    Of a subject's pieces of PIECE characters the one that fewest nodes hold is looked up by an equi-join, and only the
    nodes that hold it are searched; shorter subjects are pieces themselves. Nodes are cut into pieces twice and never paired with subjects.
    """
    low = F.lower("subject")
    asked = subjects.select("subject", low.alias("low"), F.least(F.length(low), F.lit(PIECE)).alias("size")).filter("size > 0")
    sizes = [r["size"] for r in asked.select("size").distinct().collect()]  # 1 to PIECE
    if not sizes:
        return nodes.select(F.lit("").alias("subject"), "id", F.lit(0).alias("score")).limit(0)
    probes = asked.withColumn("piece", F.explode(F.coalesce(*[F.when(F.col("size") == n, _pieces(F.col("low"), n)) for n in sizes])))
    texts = nodes.select("id", F.lower("name").alias("low_name"), F.lower("id").alias("low_id"))
    held = F.array_distinct(F.concat(*[_pieces(F.col(c), n) for n in sizes for c in ("low_name", "low_id")]))
    cut = texts.withColumn("piece", F.explode(held))
    counts = cut.join(bounded(probes.select("piece").distinct()), "piece").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = probes.join(counts, "piece", "left").groupBy("subject", "low").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    found = cut.join(bounded(rarest), "piece")
    part = F.when(F.contains("low_name", F.col("low")), PART_OF_NAME).when(F.contains("low_id", F.col("low")), PART_OF_ID)
    return found.select("subject", "id", part.alias("score")).filter("score IS NOT NULL")


def resolve_typed(nodes: DataFrame, subjects: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(subject, type, id, state) of subjects with a type: auto, path, symbol, package or result_id.

    path: equal to the path of a file; package: key or name, then directory, then either by case; result_id: the id;
    symbol: among symbols only; auto: as a path if it has a slash and one file has it, else among all nodes.
    """
    typed = lambda *kinds: subjects.filter(F.col("type").isin(*kinds)).select("subject", "type")
    files = nodes.filter(F.col("kind").isin(*FILE_KINDS)).select("id", F.col("path").alias("subject"))
    as_path = typed("path", "auto").filter((F.col("type") == "path") | F.contains("subject", F.lit("/"))).join(files, "subject")
    as_path = as_path.withColumn("n", F.count("*").over(Window.partitionBy("subject", "type"))).filter((F.col("type") == "path") | (F.col("n") == 1))
    as_path = as_path.select("subject", "type", "id", "n")
    by_id = typed("result_id").join(nodes.select(F.col("id").alias("subject"), "id"), "subject").select("subject", "type", "id", F.lit(1).cast("long").alias("n"))
    folder = F.substring_index("key", "#", 1)
    forms = F.array(*[F.struct(x.alias("form"), F.lit(t).alias("score")) for x, t in ((F.col("key"), 0), (F.col("name"), 0), (F.concat(F.lit("\1"), folder), 1), *((F.concat(F.lit("\0"), F.lower(c)), 2) for c in (F.col("key"), F.col("name"), folder)))])
    packages = nodes.filter("kind = 'package'").select("id", F.explode(forms).alias("f")).select("id", "f.*")
    wanted = typed("package").select("subject", "type", F.explode(F.array(F.col("subject"), F.concat(F.lit("\1"), "subject"), F.concat(F.lit("\0"), F.lower("subject")))).alias("form"))
    package = wanted.join(packages, "form").groupBy("subject", "type", "id").agg(F.min("score").alias("score"))
    per = Window.partitionBy("subject", "type")
    package = package.withColumn("best", F.min("score").over(per)).filter("score = best").withColumn("n", F.count("*").over(per)).select("subject", "type", "id", "n")
    symbols = resolve(nodes.filter("kind = 'symbol'"), typed("symbol"), limit)
    others = resolve(nodes, typed("auto").join(as_path.filter("type = 'auto'").select("subject"), "subject", "left_anti"), limit)
    found = top(as_path.unionByName(by_id).unionByName(package), limit, ["subject", "type"], F.col("id")).select("subject", "type", "id", F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("state"))
    named = lambda df, t: df.select("subject", F.lit(t).alias("type"), "id", "state")
    return found.unionByName(named(symbols, "symbol")).unionByName(named(others, "auto"))


def seed_scope(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(subject, seed): resolved subjects (subject, id); a file stands for every node of its path, any other node for itself."""
    own = resolved.select("subject", "id").join(nodes.select("id", "kind", "path"), "id")
    file = F.col("kind").isin(*FILE_KINDS) & (F.coalesce("path", F.lit("")) != "")
    wide = own.filter(file).select("subject", "path").join(nodes.select("path", F.col("id").alias("seed")), "path").select("subject", "seed")
    return wide.unionByName(own.filter(~file).select("subject", F.col("id").alias("seed"))).distinct()


def best_targets(rows: DataFrame, by: str = "subject") -> DataFrame:
    """One row a target: the surest path (then not heuristic, the shorter text, path, method, kind), how many others were left out and their kinds.

    rows: (by, other, kind, confidence, heuristic, text, path, method).
    """
    fields = ["kind", "confidence", "heuristic", "text", "path", "method"]
    order = F.struct((-F.col("confidence")).alias("a"), F.col("heuristic").alias("b"), F.length("text").alias("c"), F.col("path").alias("d"), F.col("method").alias("e"), F.col("kind").alias("f"), F.col("text").alias("g"))
    best = rows.groupBy(by, "other").agg(F.min_by(F.struct(*fields), order).alias("x"), F.count("*").alias("n"), F.collect_set("kind").alias("kinds"))  # kinds are few
    others = F.array_sort(F.array_except("kinds", F.array("x.kind")))
    return best.select(by, "other", "x.*", (F.col("n") - 1).alias("suppressed"), others.alias("other_kinds"))


def last_segment(x: Column) -> Column:
    return F.substring_index(x, "/", -1)


def nearest_names(nodes: DataFrame, subjects: DataFrame, most: int = EDITS, k: int = HINTS) -> DataFrame:
    """Did-you-mean: names within an edit distance of the subject's last path segment, nearest first. A symbol goes by its name, a file by
    its base name. Of a name cut into one part more than edits are allowed, some part stays whole: names are joined with subjects by
    their length, a part's number and its text at any place up to that many characters away, and only those are compared."""
    hint = F.when(F.col("kind") == "symbol", F.col("name")).when(F.col("kind").isin(*FILE_KINDS), last_segment(F.col("key"))).otherwise(F.col("name")) if "kind" in nodes.columns else F.col("name")
    names = nodes.select(hint.alias("name")).distinct().withColumn("low", F.lower("name"))
    asked = subjects.select("subject", F.lower(last_segment(F.trim("subject"))).alias("target")).distinct()
    start, size = _segment(F.length("low"), F.col("i"), most + 1)
    held = names.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most)))).select("name", "low", F.length("low").alias("n"), "i", F.substring("low", start + 1, size).alias("piece"))
    probes = asked.withColumn("n", F.explode(F.sequence(F.greatest(F.length("target") - most, F.lit(0)), F.length("target") + most)))
    probes = probes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    start, size = _segment(F.col("n"), F.col("i"), most + 1)
    place = start + F.col("shift")
    probes = probes.filter((place >= 0) & (place + size <= F.length("target"))).select("subject", "target", "n", "i", F.substring("target", place + 1, size).alias("piece")).distinct()
    near = held.join(bounded(probes), ["n", "i", "piece"]).select("subject", "target", "name", "low").distinct()
    near = near.withColumn("edits", F.levenshtein("low", "target", most)).filter("edits >= 0")
    return top(near, k, ["subject"], F.col("edits"), F.col("name")).select("subject", "name", "edits", "rank")


def _segment(n: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """(start, length) of part i of `parts` even parts of a text of n characters, the longer ones last."""
    short, longer = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    before = F.greatest(i - (parts - longer), F.lit(0))  # longer parts before this one
    return (i * short + before).cast("int"), (short + (i >= parts - longer).cast("int")).cast("int")


#: Languages that are code but that no extractor reads.
UNREAD = {"rs": "rust", "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "swift": "swift", "sh": "shell", "bash": "shell", "cs": "csharp", "scala": "scala"}


def language_warning(subject: Column) -> Column:
    """The language that a subject's path, or the first part of its name, asks for, if no extractor reads it; else null."""
    known = F.create_map(*[F.lit(x) for kv in UNREAD.items() for x in kv])
    by_path = known[F.lower(F.regexp_extract(subject, r"\.([A-Za-z]+)$", 1))]
    start = F.lower(F.regexp_extract(subject, r"^([A-Za-z]+)_", 1))
    return F.coalesce(by_path, F.when(start.isin(*sorted(set(UNREAD.values()) - {"c"})), start))
