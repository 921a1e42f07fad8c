"""Candidates, sub-queries, graph answers, profiles, reconciliation and evaluation labels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.text import glob_regex
from gleaner.operators import bm25, candidates, decompose, graph, maintenance, metadata, ranking
from gleaner.plans.graphs import SQL_EDGES, edges
from gleaner.plans.search import SQL_BM25, SQL_META, few, index_of, keyword, with_metadata
from gleaner.plans.texts import SQL_PATH, SQL_QUERIES, path_of
from gleaner.registry import query
from gleaner.session import table


def _chunks(spark, sf_dir):
    """Documents as chunks of one each: (id, path, start_line, content, n_chars)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path_of().alias("path"), (F.col("doc_id") % 50).alias("start_line"), F.col("text").alias("content"), "source", "n_chars")


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))


# --- graph: documents as files, sources as packages, first words as symbols

_NODES = f"""n AS (SELECT doc_id, {SQL_PATH} AS path, source, string_split(text, ' ')[1] AS word FROM documents), nodes AS (
 SELECT 'node:' || k || ':shop:' || path AS id, k AS kind, path AS key, regexp_extract(path, '([^/]*)$', 1) AS name, path FROM (SELECT path, CASE WHEN path LIKE '%.md' THEN 'doc' WHEN path LIKE 'tests/%' OR path LIKE '%\\_test.go' ESCAPE '\\' THEN 'test_file' ELSE 'file' END AS k FROM n)
 UNION ALL SELECT DISTINCT 'node:package:shop:' || p || '#' || source, 'package', p || '#' || source, source, p FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS p, source FROM n)
 UNION ALL SELECT DISTINCT 'node:symbol:shop:' || path || '#' || word, 'symbol', path || '#' || word, word, path FROM n)"""
_ASKED = (("internal/src1/14.go", "path"), ("docs/src1/9.md", "path"), ("docs/src2/9.md", "auto"), ("SRC3", "package"), ("src1", "package"), ("docs/src2", "package"), ("The", "symbol"), ("zzz", "symbol"), ("node:doc:shop:docs/src0/9.md", "result_id"), ("9.md", "auto"), ("7.go", "auto"))
_ASKED_SQL = "asked(subject, type) AS (VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in _ASKED) + ")"
_RESOLVED = f"""{_NODES}, {_ASKED_SQL}, fk AS (SELECT * FROM nodes WHERE kind IN ('file', 'test_file', 'doc', 'config_file')),
ap AS (SELECT * FROM (SELECT subject, type, id, count(*) OVER (PARTITION BY subject, type) AS n FROM asked JOIN fk ON path = subject WHERE type = 'path' OR (type = 'auto' AND contains(subject, '/'))) WHERE type = 'path' OR n = 1),
pk AS (SELECT subject, type, id, min(CASE WHEN key = subject OR name = subject THEN 0 WHEN string_split(key, '#')[1] = subject THEN 1 WHEN lower(key) = lower(subject) OR lower(name) = lower(subject) OR lower(string_split(key, '#')[1]) = lower(subject) THEN 2 END) AS score
  FROM asked, nodes WHERE type = 'package' AND kind = 'package' GROUP BY 1, 2, 3),
pb AS (SELECT subject, type, id, count(*) OVER (PARTITION BY subject) AS n FROM (SELECT *, min(score) OVER (PARTITION BY subject) AS best FROM pk WHERE score IS NOT NULL) WHERE score = best),
ge AS (SELECT subject, type, id, CASE WHEN key = subject THEN 0 WHEN path = subject THEN 1 WHEN name = subject THEN 2 WHEN id = subject THEN 3 WHEN lower(key) = lower(subject) THEN 4 WHEN lower(path) = lower(subject) THEN 5 WHEN lower(name) = lower(subject) THEN 6
  WHEN lower(id) = lower(subject) THEN 7 WHEN contains(lower(name), lower(subject)) THEN 10 WHEN contains(lower(id), lower(subject)) THEN 11 END AS score FROM asked, nodes WHERE (type = 'symbol' AND kind = 'symbol') OR (type = 'auto' AND subject NOT IN (SELECT subject FROM ap WHERE type = 'auto'))),
gb AS (SELECT subject, type, id, count(*) OVER (PARTITION BY subject, type) AS n FROM (SELECT *, min(score) OVER (PARTITION BY subject, type) AS best FROM ge WHERE score IS NOT NULL) WHERE score = best),
un AS (SELECT * FROM ap UNION ALL SELECT subject, type, id, n FROM pb UNION ALL SELECT subject, type, id, n FROM gb UNION ALL SELECT subject, type, subject, 1 FROM asked WHERE type = 'result_id' AND subject IN (SELECT id FROM nodes)),
resolved AS (SELECT subject, type, id, CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY subject, type ORDER BY id) AS rn FROM un) WHERE rn <= 10)"""


def _file_nodes(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(path_of().alias("path"), "source", F.split("text", " ")[0].alias("word"))
    path = F.col("path")
    kind = F.when(path.endswith(".md"), "doc").when(path.startswith("tests/") | path.endswith("_test.go"), "test_file").otherwise("file")
    made = lambda k, key, name, p: n.select(graph.node_id(k, key).alias("id"), (F.lit(k) if isinstance(k, str) else k).alias("kind"), key.alias("key"), name.alias("name"), p.alias("path"))
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    out = made(kind, path, graph.last_segment(path), path).unionByName(made("package", F.concat_ws("#", folder, "source"), F.col("source"), folder).distinct())
    return out.unionByName(made("symbol", F.concat_ws("#", path, "word"), F.col("word"), path).distinct())


def _asked(spark):
    return spark.createDataFrame(_ASKED, "subject string, type string")


@query(f"WITH {_RESOLVED} SELECT * FROM resolved")
def typed_subjects(spark, sf_dir):
    return graph.resolve_typed(_file_nodes(spark, sf_dir), _asked(spark))


@query(f"""WITH {_RESOLVED}, r AS (SELECT subject, nodes.id, kind, path FROM resolved JOIN nodes USING (id)) SELECT DISTINCT subject, nodes.id AS seed FROM r JOIN nodes USING (path) WHERE r.kind IN ('file', 'test_file', 'doc', 'config_file')
UNION SELECT subject, id FROM r WHERE kind NOT IN ('file', 'test_file', 'doc', 'config_file')""")
def seed_scope(spark, sf_dir):
    n = _file_nodes(spark, sf_dir)
    return graph.seed_scope(graph.resolve_typed(n, _asked(spark)), n)


@query(f"""WITH {SQL_EDGES}, r AS (SELECT 'shop' AS subject, dst AS other, kind, confidence, heuristic, src AS text, source AS path, id FROM edges),
b AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY confidence DESC, heuristic, length(text), path, kind, text) AS n, count(*) OVER (PARTITION BY other) AS c FROM r),
k AS (SELECT other, list_sort(list_distinct(list(kind))) AS kinds FROM r GROUP BY 1)
SELECT other, kind, confidence, text, c - 1 AS suppressed, array_to_string(list_filter(kinds, lambda x: x <> kind), ',') AS other_kinds FROM b JOIN k USING (other) WHERE n = 1""")
def best_targets(spark, sf_dir):
    """Every node that edges lead to, by its surest edge, with how many and which others there are."""
    e = edges(spark, sf_dir)
    source = F.when(F.col("kind").isin("has_part", "supplied_by"), "lineitem").when(F.col("kind") == "contains", "nation").when(F.col("kind") == "ordered_by", "orders").otherwise(F.regexp_extract("src", "^node:([a-z]+):", 1))
    rows = e.select(F.lit("shop").alias("subject"), F.col("dst").alias("other"), "kind", "confidence", "heuristic", F.col("src").alias("text"), source.alias("path"), F.lit("").alias("method"))
    return graph.best_targets(rows).select("other", "kind", "confidence", "text", "suppressed", F.array_join("other_kinds", ",").alias("other_kinds"))


@query(f"""WITH s AS (SELECT DISTINCT url AS subject FROM pages UNION SELECT DISTINCT source || '_' || doc_id || '.rs' FROM documents UNION SELECT DISTINCT {SQL_PATH} FROM documents)
SELECT subject, CASE WHEN subject LIKE '%.rs' THEN 'rust' END AS warning FROM s WHERE NOT regexp_matches(subject, '\\.(java|kt|c|h|cpp|hpp|rb|php|swift|sh|bash|cs|scala)$')""")
def language_warnings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = table(spark, sf_dir, "pages").select(F.col("url").alias("subject")).union(d.select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".rs")))).union(d.select(path_of())).distinct()
    return s.filter(~F.col("subject").rlike(r"\.(java|kt|c|h|cpp|hpp|rb|php|swift|sh|bash|cs|scala)$")).select("subject", graph.language_warning(F.col("subject")).alias("warning"))


# --- candidates


@query(f"""WITH {SQL_BM25}, d AS (SELECT doc_id, string_split(text, ' ')[1] AS name, doc_id % 50 AS line FROM documents), x AS (SELECT query, max(score) AS best FROM kw GROUP BY 1),
w AS (SELECT item_id AS query, string_split(text, ' ')[1] AS name FROM benchmark WHERE regexp_matches(string_split(text, ' ')[1], '^[A-Z][A-Za-z0-9]{{2,}}$')),
h AS (SELECT query, doc_id AS id, row_number() OVER (PARTITION BY query ORDER BY line, doc_id) AS n FROM w JOIN d USING (name))
SELECT h.query, h.id, coalesce(x.best, 1.0) AS score FROM h LEFT JOIN x USING (query) WHERE n <= 10 AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.query = h.query AND kw.id = h.id)""")
def exact_symbol_candidates(spark, sf_dir):
    """Documents that begin with the word a query is, as holders of that symbol."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.split("text", " ")[0].alias("q")).filter(F.col("q").rlike("^[A-Z][A-Za-z0-9]{2,}$"))
    symbols = _chunks(spark, sf_dir).select("id", F.substring_index("content", " ", 1).alias("name"), F.lit(0).alias("kind_rank"), F.col("start_line").alias("line"))
    return candidates.append(keyword(spark, sf_dir), q, candidates.exact_symbols(q, symbols))


_RECORDS = f"""r AS (SELECT doc_id, {SQL_PATH} AS path FROM documents), adr AS (SELECT 'docs/reference/decisions/ADR-' || doc_id || '.md' AS path, 'ADR-' || doc_id AS ref, doc_id FROM documents WHERE doc_id % 7 = 6),
refs AS (SELECT item_id AS query, 'ADR-' || (item_id * 7 + 6) AS ref FROM benchmark)"""


@query(f"""WITH {_RECORDS}, p AS (SELECT query, adr.doc_id + 1 AS first, adr.doc_id + 2 AS second FROM refs JOIN adr USING (ref)), t AS (SELECT query, first AS doc_id FROM p UNION SELECT query, second FROM p)
SELECT query, r.doc_id AS id, 1.0::DOUBLE AS score FROM t JOIN r USING (doc_id) WHERE starts_with(path, 'internal/') OR starts_with(path, 'cmd/')""")
def decision_candidates(spark, sf_dir):
    """Records that name the two documents after them; queries that ask for a record get the files it names."""
    c = _chunks(spark, sf_dir)
    q = _items(spark, sf_dir).select("query", F.concat(F.lit("why does adr-"), (F.col("query") * 7 + 6).cast("string"), F.lit(" say so")).alias("q"))
    records = c.filter(F.col("path").contains("/ADR-")).select("path", "id")
    names = records.join(c.select((F.col("id") - 1).alias("id"), F.col("path").alias("a")), "id", "left").join(c.select((F.col("id") - 2).alias("id"), F.col("path").alias("b")), "id", "left")
    text = names.select("path", F.concat_ws(" ", F.lit("see"), F.coalesce("a", F.lit("")), F.lit("and"), F.coalesce("b", F.lit(""))).alias("content"))
    named = candidates.decision_paths(q, text)
    return candidates.append(q.select("query", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0), q, candidates.chunks_of_paths(named, c, 2))


@query(f"""WITH {SQL_BM25}, h AS (SELECT item_id AS query, {SQL_PATH.replace('doc_id', '(item_id * 7)').replace('source', "'src' || (item_id % 4)")} AS path FROM benchmark), d AS (SELECT doc_id AS id, {SQL_PATH} AS path FROM documents)
SELECT h.query, d.id, coalesce(best, 1.0) AS score FROM h JOIN d USING (path) LEFT JOIN (SELECT query, max(score) AS best FROM kw GROUP BY 1) USING (query) WHERE NOT EXISTS (SELECT 1 FROM kw WHERE kw.query = h.query AND kw.id = d.id)""")
def hinted_path_candidates(spark, sf_dir):
    """Paths that sub-queries name, looked up unless the results have them; a name with a way out of the project isn't."""
    i = (F.col("query") * 7).cast("string")
    path = F.concat(F.lit("internal/src"), (F.col("query") % 4).cast("string"), F.lit("/"), i, F.lit(".go"))
    subs = _items(spark, sf_dir).select("query", F.explode(F.array(F.struct(F.lit(1).alias("sub"), path.alias("text")), F.struct(F.lit(2).alias("sub"), F.concat(F.lit("../"), path).alias("text")))).alias("s")).select("query", "s.*")
    c = _chunks(spark, sf_dir)
    return candidates.append(keyword(spark, sf_dir), _items(spark, sf_dir), candidates.chunks_of_paths(candidates.hinted_paths(subs), c, candidates.HINT_CHUNKS))


@query("""WITH c AS (SELECT page_id AS id, 'docs/' || page_id || '.pdf' AS path, page_id % 5 AS start_line, lower('docs/' || page_id || '.pdf' || chr(10) || html) AS said FROM pages ORDER BY 2, 3, 1 LIMIT 48),
q AS (SELECT item_id AS query, list_distinct(list_filter(regexp_split_to_array(lower('which pdf tells of ' || array_to_string(list_slice(string_split(lower(text), ' '), 1, 6), ' ')), '[^a-z0-9]+'),
  lambda w: length(w) >= 3 AND w NOT IN ('the', 'are', 'was', 'were', 'been', 'being', 'have', 'has', 'had', 'does', 'did', 'will', 'would', 'could', 'should', 'may', 'might', 'must', 'can', 'for', 'with', 'from', 'into', 'through', 'during', 'before', 'after', 'above', 'below', 'between', 'under', 'and', 'but', 'how', 'pdf', 'what', 'where', 'which', 'find', 'show'))) AS terms FROM benchmark),
o AS (SELECT query, id, len(list_filter(terms, lambda t: contains(said, t)))::BIGINT AS overlap, path, start_line FROM q, c)
SELECT query, id, round(1 + 0.05 * overlap, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY overlap DESC, path, start_line) AS n FROM o WHERE overlap > 0) WHERE n <= 8""")
def pdf_candidates(spark, sf_dir):
    """Pages stand for passages of PDF files; the first words of a benchmark item for a question about them."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("docs/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("path"), (F.col("page_id") % 5).alias("start_line"), F.col("html").alias("content"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.concat(F.lit("which pdf tells of "), F.array_join(F.slice(F.split(F.lower("text"), " "), 1, 6), " ")).alias("q"))
    none = q.select("query", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
    return candidates.append(none, q, candidates.pdf_passages(q, p)).select("query", "id", F.round("score", 6).alias("score"))


# --- sub-queries


_SUBS = """SELECT item_id, k AS sub, CASE k WHEN 1 THEN w[1] WHEN 2 THEN lower(w[1]) || '.go' WHEN 3 THEN w[2] WHEN 4 THEN lower(w[2]) || '.go' ELSE 'func ' || upper(lower(w[2])[1]) || lower(w[2])[2:] END AS text, CASE WHEN k IN (2, 4) THEN 1.1 ELSE 1.0 END::DOUBLE AS weight,
 CASE WHEN k IN (1, 3) THEN '' ELSE 'code' END AS hint FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[^a-zA-Z]+'), lambda x: length(x) >= 8) AS w FROM benchmark), (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= 2 AND w[1] <> w[2] AND lower(w[1]) <> lower(w[2])"""


def _how(spark, sf_dir):
    w = F.filter(F.split("text", "[^a-zA-Z]+"), lambda x: F.length(x) >= 8)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), w.alias("w")).filter((F.size("w") >= 2) & (F.lower(F.get("w", F.lit(0))) != F.lower(F.get("w", F.lit(1)))))
    return b.select("query", F.concat(F.lit("How does "), F.get("w", F.lit(0)), F.lit(" "), F.get("w", F.lit(1)), F.lit(" work")).alias("q"))


@query(f"SELECT item_id AS query, sub, text, weight, hint FROM ({_SUBS})")
def sub_queries(spark, sf_dir):
    """Questions of the form `how does X Y work` over two long words of each benchmark item, decomposed."""
    return decompose.sub_queries(_how(spark, sf_dir))


_SUB_BM25 = SQL_BM25.replace(SQL_QUERIES, f"SELECT item_id * 10 + sub AS item_id, text AS q FROM ({_SUBS})").replace("<= 20)", "<= 50)")


@query(f"""WITH sub AS ({_SUBS}), {_SUB_BM25}, r AS (SELECT sub.item_id AS query, id, rank, weight AS w FROM kw JOIN sub ON kw.query = sub.item_id * 10 + sub),
s AS (SELECT query, id, sum(w::DOUBLE / (60 + rank)) * (1 + 0.1 * (count(*) - 1)) AS raw, count(*) AS hits FROM r GROUP BY 1, 2), n AS (SELECT query, id, hits, round(raw / max(raw) OVER (PARTITION BY query), 6) AS rrf FROM s)
SELECT * FROM (SELECT query, id, hits, rrf, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, hits DESC, id) AS rank FROM n) WHERE rank <= 10""")
def multi_query_search(spark, sf_dir):
    """All sub-queries of all queries in one keyword search, fused for each query."""

    def search(q, depth):
        return bm25.best_built(spark, index_of(spark, sf_dir), q, "query", "q", depth)

    return decompose.search_many(decompose.sub_queries(_how(spark, sf_dir)), search, 10).select("query", "id", "hits", "rrf", "rank")


@query(f"""WITH {SQL_BM25}, f AS (SELECT query, id, {SQL_PATH} AS path, text, score, doc_id FROM kw JOIN documents ON doc_id = id), k AS (SELECT *, string_split(text, ' ')[1] AS sym, CASE WHEN doc_id % 2 = 0 THEN 'class' ELSE 'interface' END AS kind FROM f)
SELECT query, id, CASE WHEN query % 3 = 0 AND sym = 'The' AND kind = 'class' THEN 4.0 WHEN query % 3 = 0 AND sym = 'The' THEN 0.2 WHEN query % 3 = 1 AND sym = 'The' THEN 4.0 WHEN query % 3 = 2 AND contains(text, 'the') THEN 1.2 ELSE 1.0 END::DOUBLE AS factor FROM k""")
def exact_match_factors(spark, sf_dir):
    """A declaration, a symbol and a quoted phrase as queries: the right kind of symbol is raised, a wrong one held back."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path_of().alias("path"), "text")
    x = few(spark, sf_dir, keyword(spark, sf_dir)).join(d, "id")
    q = F.when(F.col("query") % 3 == 0, "type The struct").when(F.col("query") % 3 == 1, "The").otherwise('"the"')
    asked, kind = candidates.needle(q), F.when(F.col("id") % 2 == 0, "class").otherwise("interface")
    factor = ranking.exact_factor(F.col("path"), F.col("text"), F.array(F.split("text", " ")[0]), asked["text"], asked["quoted"], kind, candidates.declared_kinds(q))
    return x.select("query", "id", F.coalesce(factor, F.lit(1.0)).cast("double").alias("factor"))


# --- profiles, ignore files, resources, labels


@query(f"""WITH {SQL_META} SELECT doc_id, source_class NOT IN ('archived', 'raw_evidence') AS plain, regexp_matches(path, '^(internal|cmd|pkg|configs|app|tests)/') AND source_class IN ('source_code', 'test', 'config') AND authority NOT IN ('archived', 'raw_evidence') AS code,
 (regexp_matches(path, '^docs/') OR path = 'README.md') AND source_class IN ('docs', 'adr', 'config', 'unknown') AND authority NOT IN ('archived', 'raw_evidence') AS project_memory,
 NOT starts_with(path, 'archive/') AND source_class IN ('raw_evidence', 'docs', 'unknown') AND authority <> 'archived' AS review_corpus, starts_with(path, 'archive/') AND source_class = 'archived' AS archive FROM meta""")
def profile_eligibility(spark, sf_dir):
    """Which profiles' searches may return each document."""
    m = with_metadata(spark, sf_dir)
    ok = lambda p: metadata.eligible(F.col("path"), F.col("meta"), p)
    return m.select("doc_id", ok(None).alias("plain"), *[ok(p).alias(p) for p in metadata.PROFILES])


@query(f"""WITH {SQL_META} SELECT doc_id, 'class ' || source_class || ', authority ' || authority AS reason FROM meta WHERE NOT (starts_with(path, 'archive/') AND source_class = 'archived')""")
def profile_mismatches(spark, sf_dir):
    """What a search of the archive leaves out, and why."""
    return metadata.with_mismatches(with_metadata(spark, sf_dir), "archive")[1].select("doc_id", "reason")


_OLD_IGNORE, _NEW_IGNORE = "archive/\n*_test.go\n# note\n", "archive/\ndocs/src1/\n*.txt\n"


@query(f"""WITH p AS (SELECT doc_id, {SQL_PATH} AS path FROM documents), i AS (SELECT * FROM p WHERE NOT starts_with(path, 'archive/') AND NOT path LIKE '%\\_test.go' ESCAPE '\\')
SELECT path, 'remove' AS change FROM i WHERE starts_with(path, 'docs/src1/') OR path LIKE '%.txt' UNION ALL SELECT path, 'add' FROM p WHERE path LIKE '%\\_test.go' ESCAPE '\\'""")
def ignore_reconciliation(spark, sf_dir):
    """After an ignore file changed: indexed files that an added pattern matches go, files that a removed one had hidden come."""
    p = table(spark, sf_dir, "documents").select(path_of().alias("path"))
    old = maintenance.IgnoreRules(_OLD_IGNORE.splitlines())
    gone, come = maintenance.reconciled(p.filter(~old.ignored(F.col("path"))), p, ".gitignore", _OLD_IGNORE, _NEW_IGNORE)
    return gone.withColumn("change", F.lit("remove")).unionByName(come.withColumn("change", F.lit("add")))


@query(f"SELECT path FROM (SELECT {SQL_PATH} AS path FROM documents) ORDER BY path LIMIT 40 OFFSET 40")
def resource_page(spark, sf_dir):
    """The second page of resources, found by the first one's cursor."""
    p = table(spark, sf_dir, "documents").select(path_of().alias("path"))
    _, after = maintenance.page_of(p, "", 40)
    return maintenance.page_of(p, after, 40)[0]


@query("""WITH c AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'stale' WHEN 2 THEN 'partial' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'incompatible' WHEN 5 THEN 'failed' WHEN 6 THEN '' ELSE 'ready' END AS status,
 CASE event_type WHEN 'click' THEN ['graph_stale_edges'] WHEN 'view' THEN ['traversal_budget_exhausted'] WHEN 'error' THEN ['build_failed', 'unsupported_language'] WHEN 'signup' THEN ['graph_results_truncated'] ELSE [] END AS codes, value > 90 AS stale, value < 1 AS invalid, event_id % 3 = 0 AS exhausted FROM events),
l AS (SELECT *, [CASE status WHEN 'empty' THEN 'empty_graph' WHEN 'stale' THEN 'stale_graph' WHEN 'partial' THEN 'partial_graph' WHEN 'unavailable' THEN 'unavailable_graph' WHEN 'incompatible' THEN 'incompatible_graph' WHEN 'failed' THEN 'failed_graph' END,
 CASE WHEN list_contains(codes, 'graph_stale_edges') OR stale THEN 'stale_edges' END, CASE WHEN list_contains(codes, 'traversal_budget_exhausted') THEN 'traversal_budget_exhausted' END, CASE WHEN list_contains(codes, 'build_failed') THEN 'failed_graph' END,
 CASE WHEN list_contains(codes, 'unsupported_language') OR event_id % 5 = 0 THEN 'unsupported_language' END, CASE WHEN list_contains(codes, 'graph_results_truncated') OR (list_contains(codes, 'traversal_budget_exhausted') AND exhausted) THEN 'result_truncated' END,
 CASE WHEN invalid THEN 'invalid_params' END, CASE WHEN status = '' AND NOT invalid THEN 'unavailable_graph' END] AS all_labels FROM c), d AS (SELECT *, list_sort(list_distinct(list_filter(all_labels, lambda x: x IS NOT NULL))) AS labels FROM l)
SELECT event_id, array_to_string(labels, ',') AS labels, array_to_string(list_filter(labels, lambda x: x <> 'failed_graph' AND CASE WHEN x IN ('empty_graph', 'stale_graph', 'partial_graph', 'unavailable_graph', 'incompatible_graph') THEN status IN ('empty', 'unavailable')
 WHEN x = 'stale_edges' THEN event_id % 2 = 1 WHEN x = 'result_truncated' THEN event_id % 20 < 10 WHEN x = 'traversal_budget_exhausted' THEN exhausted AND event_id % 20 < 10 ELSE true END), ',') AS blocking FROM d""")
def graph_degradation(spark, sf_dir):
    """Labels of degraded answers and which of them block, with states made from events; a failed graph is expected."""
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("empty", "stale", "partial", "unavailable", "incompatible", "failed", "", "ready"))), (k % 8 + 1).cast("int"))
    none = F.expr("cast(array() as array<string>)")
    codes = F.when(F.col("event_type") == "click", F.array(F.lit("graph_stale_edges"))).when(F.col("event_type") == "view", F.array(F.lit("traversal_budget_exhausted")))
    codes = codes.when(F.col("event_type") == "error", F.array(F.lit("build_failed"), F.lit("unsupported_language"))).when(F.col("event_type") == "signup", F.array(F.lit("graph_results_truncated"))).otherwise(none)
    e = table(spark, sf_dir, "events").select(k, status.alias("status"), codes.alias("codes"), (F.col("value") > 90).alias("stale"), (F.col("value") < 1).alias("invalid"), (k % 3 == 0).alias("exhausted"))
    language = F.when(k % 5 == 0, "Fortran").otherwise("")
    e = e.withColumn("labels", maintenance.degradation(F.col("status"), F.col("codes"), F.col("stale"), language, F.col("invalid"), F.lit(True), F.col("exhausted")))
    stops = maintenance.blocking(F.col("labels"), F.array(F.lit("failed_graph")), F.col("status"), F.array(F.lit("empty"), F.lit("unavailable")), k % 2 == 0, k % 20, F.col("exhausted"))
    return e.select("event_id", F.array_join("labels", ",").alias("labels"), F.array_join(stops, ",").alias("blocking"))


@query("""WITH c AS (SELECT doc_id AS id, lang AS class, source AS job, CASE WHEN doc_id % 3 = 0 THEN 'graph' ELSE 'graded' END AS section, doc_id % 10 = 0 AS holdout FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY id) AS of_class FROM c),
k AS (SELECT id FROM n ORDER BY of_class > 1, id LIMIT 15)
SELECT 'quick' AS selection, id FROM k UNION ALL SELECT 'holdout', id FROM c WHERE holdout UNION ALL SELECT 'graph', id FROM c WHERE section = 'graph' UNION ALL SELECT 'class:de', id FROM c WHERE class = 'de' UNION ALL SELECT 'job:src1', id FROM c WHERE job = 'src1'""")
def case_subsets(spark, sf_dir):
    """Selections of evaluation cases, documents standing for them."""
    d = table(spark, sf_dir, "documents")
    c = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("class"), F.col("source").alias("job"), F.when(F.col("doc_id") % 3 == 0, "graph").otherwise("graded").alias("section"), (F.col("doc_id") % 10 == 0).alias("holdout"))
    out = None
    for s in ("quick", "holdout", "graph", "class:de", "job:src1"):
        part = maintenance.subset(c, s).select(F.lit(s).alias("selection"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {SQL_BM25}, r AS (SELECT query, CASE WHEN id % 4 = 0 THEN 'text' ELSE 'code' END AS kind, CASE WHEN id % 5 = 0 THEN 'run_part2' WHEN id % 7 = 0 THEN '' ELSE 'run' END AS title FROM kw),
c AS (SELECT query, count(*) AS chunks, sum(CASE WHEN kind = 'text' OR title LIKE '%\\_part2' ESCAPE '\\' OR title = '' THEN 1 ELSE 0 END)::BIGINT AS by_lines FROM r GROUP BY 1)
SELECT query, chunks, by_lines, round(by_lines / chunks, 6) AS line_rate, CASE WHEN by_lines = 0 THEN 'full' WHEN round(by_lines / chunks, 6) < 0.5 THEN 'mixed' ELSE 'degraded' END AS quality FROM c""")
def chunk_provenance(spark, sf_dir):
    """How many results were cut by lines rather than by syntax."""
    title = F.when(F.col("id") % 5 == 0, "run_part2").when(F.col("id") % 7 == 0, "").otherwise("run")
    return maintenance.provenance(keyword(spark, sf_dir).select("query", F.when(F.col("id") % 4 == 0, "text").otherwise("code").alias("kind"), title.alias("title")))


@query(f"""WITH {SQL_BM25}, g AS (SELECT query, count(*)::BIGINT AS found, list(id ORDER BY id) AS ids FROM kw GROUP BY 1), j AS (SELECT item_id AS query, coalesce(found, 0) AS found, coalesce(ids, []) AS ids FROM benchmark LEFT JOIN g ON item_id = query)
SELECT query, found >= 1 AND found <= 15 AND (query % 2 = 1 OR found >= 3) AND NOT (query % 4 = 0 AND found = 0) AND NOT list_contains(ids, query) AS passes FROM j""")
def negative_cases(spark, sf_dir):
    """Negative cases with bounds of results, a wanted resolution, candidates, a warning for nothing found, and forbidden evidence."""
    g = keyword(spark, sf_dir).groupBy("query").agg(F.count("*").alias("found"), F.collect_list("id").alias("ids"))  # a ranking's depth
    j = _items(spark, sf_dir).join(g, "query", "left").select("query", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("ids", F.expr("cast(array() as array<bigint>)")).alias("ids"))
    none = F.expr("cast(array() as array<string>)")
    odd = F.col("query") % 2 == 1
    wanted = F.when(F.col("query") % 4 == 0, "some")
    passes = maintenance.negative_passes(F.col("found"), F.lit(1), F.lit(15), wanted, F.when(F.col("found") > 0, "some").otherwise("none"), F.col("found"), F.when(odd, 0).otherwise(3), none, none, F.array("query"), F.col("ids"))
    return j.select("query", passes.alias("passes"))


@query(f"SELECT doc_id, ceil(octet_length(encode('{{\"doc_id\":' || doc_id || ',\"path\":\"' || path || '\"}}')) / 4)::BIGINT AS tokens FROM (SELECT doc_id, {SQL_PATH} AS path FROM documents)")
def response_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", path_of().alias("path"))
    return d.select("doc_id", maintenance.response_tokens(d, "doc_id", "path").alias("tokens"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {SQL_PATH} AS path FROM documents) WHERE regexp_matches(path, '^docs/reference/decisions/')")
def decision_scope(spark, sf_dir):
    """Documents in the folders that decision records are kept in, as the metadata rules say."""
    d = table(spark, sf_dir, "documents").select("doc_id", path_of().alias("path"))
    return d.filter(F.col("path").rlike("|".join(glob_regex(f"{p}/**") for p in metadata.scope_prefixes()))).select("doc_id")
