"""Relations between files: imports, symbols, settings, tests and mentions, as native expressions over (path, content)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.joins import top
from gleaner.functions.text import is_test_path

#: Language of an extension, and kind of content.
EXTENSIONS = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "md": "markdown", "mdx": "markdown", "pdf": "pdf", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "env": "env", "properties": "properties"}
CODE = ("go", "python", "typescript", "javascript")
SETTINGS = ("yaml", "json", "toml", "env", "properties")
#: How sure each kind of edge is.
CONFIDENCE = {"import": 0.95, "relative_import": 0.9, "defines": 0.95, "config_key": 0.9, "test_by_name": 0.72, "test_by_import": 0.45, "mention_code": 0.72, "mention_link": 0.9}


def language(path: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))], F.lit("text"))


def content_type(lang: Column) -> Column:
    return F.when(lang.isin(*CODE), "code").when(lang == "markdown", "markdown").when(lang == "pdf", "pdf").when(lang.isin(*SETTINGS), "config").otherwise("text")


def imports(files: DataFrame) -> DataFrame:
    """(path, target): what each code file imports, by the forms of its language."""
    lang, text = language(F.col("path")), F.col("content")
    block = F.regexp_extract_all(F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)import\s*\(([^)]*)\)"), F.lit(1)), "\n"), F.lit(r'"([^"]+)"'), F.lit(1))
    go = F.concat(block, F.regexp_extract_all(text, F.lit(r'(?m)^import\s+(?:\w+\s+)?"([^"]+)"'), F.lit(1)))
    js = F.regexp_extract_all(text, F.lit(r"""(?:from|import|require\()\s*["']([^"']+)["']"""), F.lit(1))
    py = F.concat(F.regexp_extract_all(text, F.lit(r"(?m)^import\s+([\w.]+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?m)^from\s+([\w.]+)\s+import"), F.lit(1)))
    found = F.when(lang == "go", go).when(lang == "python", py).when(lang.isin("typescript", "javascript"), js)
    return files.select("path", F.explode(F.array_distinct(found)).alias("target"))


def wanted_imports(files: DataFrame) -> DataFrame:
    """(path, target, file): every file that an import could mean, by suffixes of its target and the endings of its language."""
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    dotted = F.replace("target", F.lit("."), F.lit("/"))
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("target", "/"))), lambda i: F.array_join(F.slice(F.split("target", "/"), i, F.size(F.split("target", "/"))), "/"))
    stems = F.concat(tails, F.array(dotted, F.concat(F.lit("src/"), dotted), F.concat(folder, F.regexp_replace("target", r"^\./", ""))))
    probes = F.flatten(F.transform(stems, lambda s: F.transform(F.array(*map(F.lit, ["", ".go", ".py", ".ts", ".js", "/index.ts", "/index.js", "/__init__.py"])), lambda e: F.concat(s, e))))
    return imports(files).withColumn("file", F.explode(F.array_distinct(probes))).filter("file <> path")


def resolved_imports(files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(path, target, file): imports of files that name a known file (paths: path, by default those of `files`): candidate paths
    are made for each and joined, never compared in pairs."""
    known = (files if paths is None else paths).select(F.col("path").alias("file"))
    return wanted_imports(files).join(known, "file").groupBy("path", "target").agg(F.min("file").alias("file"))


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, line): declarations at line starts."""
    pattern = r"(?m)^[ \t]*(?:export\s+)?(?:async\s+)?(func(?:\s*\([^)\n]*\))?|function|class|interface|type|def|struct)\s+(\w+)"
    heads, names = (F.regexp_extract_all("content", F.lit(pattern), F.lit(i)) for i in (1, 2))
    lines = F.filter(F.transform(F.split("content", "\n"), lambda l, i: F.when(l.rlike(pattern), i + 1)), lambda x: x.isNotNull())
    rows = files.filter(content_type(language(F.col("path"))) == "code").select("path", F.explode(F.arrays_zip(heads.alias("h"), names.alias("n"), lines.alias("l"))).alias("s"))
    head = F.col("s")["h"]
    kind = F.when(head.startswith("func ") | head.rlike(r"^func\s*\("), "method").when(head.isin("func", "function", "def"), "function").when(head.isin("class", "struct"), "class").otherwise(head)
    return rows.select("path", F.col("s")["n"].alias("name"), kind.alias("kind"), F.col("s")["l"].cast("int").alias("line"))


def _json_keys(text: str) -> list[str]:
    """Dotted keys of nested JSON objects; none for a text that isn't an object."""
    try:
        todo = [("", json.loads(text))]
    except (ValueError, RecursionError):
        return []
    out: list[str] = []
    while todo:
        at, value = todo.pop()
        if isinstance(value, dict):
            named = [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
            out += [k for k, _ in named]
            todo += named
    return out


_YAML_KEY = re.compile(r"^(\s*)(?:export\s+)?[\"']?([A-Za-z_][\w.-]*)[\"']?\s*[:=]")


def _yaml_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, key): dotted keys by indentation; what is held of a file is the chain of keys above the present line."""
    for b in batches:
        found: list[tuple[str, str]] = []
        for path, text in zip(b["path"], b["content"], strict=True):
            above: list[tuple[int, str]] = []
            for line in (text or "").split("\n"):
                if m := _YAML_KEY.match(line):
                    depth = len(m[1])
                    while above and above[-1][0] >= depth:
                        above.pop()
                    above.append((depth, f"{above[-1][1]}.{m[2]}" if above else m[2]))
                    found.append((path, above[-1][1]))
        yield pd.DataFrame(found, columns=["path", "key"])


def config_keys(files: DataFrame) -> DataFrame:
    """(path, key): dotted keys of YAML by indentation, of TOML by section, of JSON by nesting, and keys of env and properties files."""
    lang = language(F.col("path"))
    f = files.select("path", "content", lang.alias("lang"))
    lines = f.filter(F.col("lang").isin("env", "properties", "toml")).select("path", "lang", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    key = F.regexp_extract("line", r"^\s*(?:export\s+)?[\"']?([A-Za-z_][\w.-]*)[\"']?\s*[:=]", 1)
    section = F.regexp_extract("line", r"^\s*\[+\s*([A-Za-z_][\w.-]*)\s*\]+", 1)
    lines = lines.withColumns({"key": key, "section": section}).filter("key <> '' OR section <> ''")
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    toml = lines.filter("lang = 'toml'").withColumn("in", F.last(F.when(F.col("section") != "", F.col("section")), ignorenulls=True).over(w))
    keys = toml.select("path", F.when(F.col("key") == "", F.col("section")).when(F.col("in").isNotNull(), F.concat_ws(".", "in", "key")).otherwise(F.col("key")).alias("key"))
    flat = lines.filter("lang IN ('env', 'properties')").select("path", "key")
    # YAML: the keys open above a line are the last of each lesser depth; one pass over a file's lines keeps just those
    yaml = f.filter("lang = 'yaml'").select("path", "content").mapInPandas(_yaml_keys, "path string, key string")

    def of_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(p, k) for p, text in zip(b["path"], b["content"], strict=True) for k in _json_keys(text or "")]
            yield pd.DataFrame(found, columns=["path", "key"])

    by_json = f.filter("lang = 'json'").select("path", "content").mapInPandas(of_json, "path string, key string")
    out = keys.unionByName(flat).unionByName(yaml).unionByName(by_json)
    return out.distinct()


def wanted_tests(files: DataFrame) -> DataFrame:
    """(path, file): the implementation that a test's name could mean."""
    tests = files.filter(is_test_path(F.col("path")))
    strip = F.regexp_replace(F.regexp_replace("path", r"_test\.(\w+)$", ".$1"), r"\.(?:test|spec)\.(\w+)$", ".$1")
    named = F.array(strip, F.regexp_replace(strip, r"(^|/)tests?/", "$1"), F.regexp_replace(strip, r"(^|/)test_([^/]+)$", "$1$2"))
    return tests.select("path", F.explode(F.array_distinct(named)).alias("file"))


def _surest_tests(by_name: DataFrame, imported: DataFrame, most: int) -> DataFrame:
    """(test, file, confidence): the surest few of what tests are named after (path, file) and what they import."""
    rows = lambda df, how: df.select(F.col("path").alias("test"), "file", F.lit(CONFIDENCE[how]).alias("confidence"))
    found = rows(by_name.filter(~is_test_path(F.col("file"))), "test_by_name").unionByName(rows(imported.filter(is_test_path(F.col("path"))), "test_by_import"))
    best = found.groupBy("test", "file").agg(F.max("confidence").alias("confidence"))
    return top(best, most, ["test"], F.col("confidence").desc(), F.col("file")).select("test", "file", "confidence")


def tested_files(files: DataFrame, most: int = 5, paths: DataFrame | None = None) -> DataFrame:
    """(test, file, confidence): a test's implementation by its name, else by what it imports; the surest few."""
    known = (files if paths is None else paths).select(F.col("path").alias("file"))
    return _surest_tests(wanted_tests(files).join(known, "file"), resolved_imports(files, paths), most)


def wanted_mentions(files: DataFrame) -> DataFrame:
    """(path, target, confidence): what documents name as inline code or link to."""
    docs = files.filter(language(F.col("path")) == "markdown")
    token = lambda pattern, kind: docs.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("target"), F.lit(CONFIDENCE[kind]).alias("confidence"))
    found = token(r"`([^`\n]+)`", "mention_code").unionByName(token(r"\]\(([^)\s#]+)", "mention_link"))
    return found.groupBy("path", "target").agg(F.max("confidence").alias("confidence"))


def mentions(files: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, target, confidence) of known `names` (target) in documents: inline code and links become tokens, joined by equality."""
    return wanted_mentions(files).join(names.select("target").distinct(), "target").select(F.col("path").alias("doc"), "target", "confidence")


def wanted(files: DataFrame) -> DataFrame:
    """(path, how, target, file, confidence): every file, known or not, that a reference of `path` could mean."""
    none, c = F.lit(""), CONFIDENCE
    out = wanted_imports(files).select("path", F.lit("import").alias("how"), "target", "file", F.lit(c["import"]).alias("confidence"))
    out = out.unionByName(wanted_tests(files).select("path", F.lit("test").alias("how"), none.alias("target"), "file", F.lit(c["test_by_name"]).alias("confidence")))
    return out.unionByName(wanted_mentions(files).select("path", F.lit("mention").alias("how"), "target", F.col("target").alias("file"), "confidence"))


def package_of(files: DataFrame) -> DataFrame:
    """(path, package): folder#name of Go files by their package clause, of Python files by their folder."""
    lang, folder = language(F.col("path")), F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1)
    name = F.when(lang == "go", F.regexp_extract("content", r"(?m)^package\s+(\w+)", 1)).when(lang == "python", F.substring_index(folder, "/", -1)).otherwise("")
    return files.select("path", F.concat_ws("#", folder, name).alias("package"), name.alias("name")).filter("name <> ''").drop("name")


#: Kinds of edges that depend on which other files there are.
CROSS = ("file_imports", "test_covers_implementation", "doc_mentions_file")


def _file_kind(p: Column) -> Column:
    return F.when(is_test_path(p), "test_file").when(content_type(language(p)) == "markdown", "doc").when(content_type(language(p)) == "config", "config_file").otherwise("file")


def _edge(df: DataFrame, project: str, name: str, src: Column, dst: Column, conf: Column, heuristic: bool, method: str) -> DataFrame:
    from gleaner.operators import graph

    eid = graph.edge_id("cheap", F.lit(name), F.lit(name), src, dst, project)
    return df.select(eid.alias("id"), F.lit(name).alias("kind"), src.alias("src"), dst.alias("dst"), conf.alias("confidence"), F.lit(heuristic).alias("heuristic"), F.lit(False).alias("stale"), "path", F.lit(method).alias("method"))


def cross_edges(candidates: DataFrame, known: DataFrame, project: str, most: int = 5) -> DataFrame:
    """Edges between files: candidates (as `wanted` gives them) that name a known path, resolved: an import to its first
    candidate by name, a test to the surest few, a mention to what it names."""
    from gleaner.operators import graph

    file_id = lambda col: graph.node_id(_file_kind(F.col(col)), F.col(col), project)
    hits = candidates.join(known.select(F.col("path").alias("file")), "file")
    imported = hits.filter("how = 'import'").groupBy("path", "target").agg(F.min("file").alias("file"))
    tests = _surest_tests(hits.filter("how = 'test'"), imported, most).withColumn("path", F.col("test"))
    out = _edge(imported, project, "file_imports", file_id("path"), file_id("file"), F.lit(CONFIDENCE["import"]), False, "import")
    out = out.unionByName(_edge(tests, project, "test_covers_implementation", file_id("test"), file_id("file"), F.col("confidence"), True, "test"))
    said = hits.filter("how = 'mention'")
    return out.unionByName(_edge(said, project, "doc_mentions_file", file_id("path"), file_id("file"), F.col("confidence"), True, "mention")).dropDuplicates(["id"])


def own_graph(files: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of files, symbols, settings and packages, and the edges that a file has by itself."""
    from gleaner.operators import graph

    file_id = graph.node_id(_file_kind(F.col("path")), F.col("path"), project)
    sym, keys, packages = symbols(files), config_keys(files), package_of(files)
    node = lambda df, k, key, name: df.select(graph.node_id(k, key, project).alias("id"), (F.lit(k) if isinstance(k, str) else k).alias("kind"), key.alias("key"), name.alias("name"), "path").distinct()
    sym_key, key_key = F.concat_ws("#", "path", "name"), F.concat_ws("#", "path", "key")
    nodes = node(files.select("path"), _file_kind(F.col("path")), F.col("path"), F.regexp_extract("path", "([^/]*)$", 1)).unionByName(node(sym, "symbol", sym_key, F.col("name")))
    nodes = nodes.unionByName(node(keys, "config_key", key_key, F.col("key"))).unionByName(node(packages, "package", F.col("package"), F.substring_index("package", "#", -1)))
    c = CONFIDENCE
    out = _edge(sym, project, "file_defines_symbol", file_id, graph.node_id("symbol", sym_key, project), F.lit(c["defines"]), False, "declaration")
    out = out.unionByName(_edge(keys, project, "file_defines_config_key", file_id, graph.node_id("config_key", key_key, project), F.lit(c["config_key"]), False, "setting"))
    return nodes, out.unionByName(_edge(packages, project, "package_contains_file", graph.node_id("package", F.col("package"), project), file_id, F.lit(1.0), False, "package")).dropDuplicates(["id"])


def file_graph(files: DataFrame, project: str, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, key, name, path) and edges (id, kind, src, dst, confidence, heuristic, stale, path, method) of all extractors in one
    pass each, unioned: packages, imports, definitions, settings, tests, mentions. paths: all known files, if `files` are only some."""
    nodes, edges = own_graph(files, project)
    return nodes, edges.unionByName(cross_edges(wanted(files), files if paths is None else paths, project))


def chunk_graph(chunks: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of chunks and the edges from their files to them."""
    from gleaner.operators import graph

    p = F.col("path")
    kind = F.when(is_test_path(p), "test_file").when(content_type(language(p)) == "markdown", "doc").when(content_type(language(p)) == "config", "config_file").otherwise("file")
    src, dst = graph.node_id(kind, p, project), graph.node_id("chunk", F.col("chunk_id"), project)
    nodes = chunks.select(dst.alias("id"), F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "title", "path").groupBy("id", "kind", "key", "path").agg(F.min("title").alias("name")).select("id", "kind", "key", "name", "path")
    eid = graph.edge_id("cheap", F.lit("file_has_chunk"), F.lit("file_has_chunk"), src, dst, project)
    edges = chunks.select(eid.alias("id"), F.lit("file_has_chunk").alias("kind"), src.alias("src"), dst.alias("dst"), F.lit(1.0).alias("confidence"), F.lit(False).alias("heuristic"), F.lit(False).alias("stale"), "path", F.lit("chunk").alias("method"))
    return nodes, edges.dropDuplicates(["id"])
