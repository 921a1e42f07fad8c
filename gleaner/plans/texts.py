"""Tokens, identifiers, predicates and query analysis over documents and benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import expansion
from gleaner.operators.expansion import SYNONYMS
from gleaner.registry import query
from gleaner.session import table

#: Code words for words of a query.
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
SQL_TOKENS = r"""list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'),
 '([A-Z0-9])([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda t: length(t) >= 2), lambda t: lower(t))"""
SQL_TERMS = f"list_filter({SQL_TOKENS}, lambda t: t NOT IN ({_STOP}))"
#: A path for a document, so that path rules have something to judge.
SQL_PATH = """CASE doc_id % 7 WHEN 0 THEN 'internal/' || source || '/' || doc_id || '.go' WHEN 1 THEN 'cmd/' || source || '/' || doc_id || '.go'
 WHEN 2 THEN 'docs/' || source || '/' || doc_id || '.md' WHEN 3 THEN 'tests/' || source || '/test_' || doc_id || '.py' WHEN 4 THEN 'archive/' || source || '/' || doc_id || '.txt'
 WHEN 5 THEN 'pkg/' || source || '/' || doc_id || '_test.go' ELSE 'docs/reference/decisions/ADR-' || doc_id || '.md' END"""


def path_of(doc_id=None, source=None):
    return F.expr(SQL_PATH.replace("doc_id ||", "cast(doc_id as string) ||").replace("|| doc_id", "|| cast(doc_id as string)"))


def queries_of(spark, sf_dir):
    """Query set: each benchmark passage, whole."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))


SQL_QUERIES = "SELECT item_id, text AS q FROM benchmark"


@query(f"SELECT doc_id, len({SQL_TOKENS.format('text')})::BIGINT AS n_tokens, sha256(array_to_string({SQL_TOKENS.format('text')}, ' ')) AS tokens_sha FROM documents")
def tokenize_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha"))


@query(f"SELECT doc_id, len({SQL_TOKENS.format('text')})::BIGINT AS n_tokens, len({SQL_TERMS.format('text')})::BIGINT AS n_terms FROM documents")
def stop_words_removed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(X.without_stop_words(F.col("t"))).cast("long").alias("n_terms"))


@query(f"""WITH d AS (SELECT doc_id, text, {SQL_PATH} AS path FROM documents)
SELECT doc_id, path, substr(sha256(path || ':' || substr(sha256(text), 1, 16)), 1, 16) AS chunk_id, (octet_length(encode(text)) // 4)::BIGINT AS est_tokens,
 length(CASE WHEN contains(text, path) THEN text ELSE 'File path: ' || path || chr(10) || text END)::BIGINT AS index_chars FROM d""")
def chunk_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", path_of().alias("path"))
    return d.select("doc_id", "path", X.chunk_id(F.col("path"), F.col("text")).alias("chunk_id"), X.estimated_tokens(F.col("text")).alias("est_tokens"), F.length(X.index_text(F.col("path"), F.col("text"))).cast("long").alias("index_chars"))


@query(f"""WITH q AS ({SQL_QUERIES}), t AS (SELECT item_id, {SQL_TERMS.format('q')} AS qt FROM q),
d AS (SELECT doc_id, {SQL_TERMS.format('text')} AS dt FROM documents)
SELECT item_id, doc_id, array_to_string(list_filter(list_distinct_in_order, lambda x: list_contains(dt, x)), ' ') AS matched
FROM (SELECT item_id, list_filter(qt, lambda x, i: list_position(qt, x) = i) AS list_distinct_in_order FROM t) CROSS JOIN d
WHERE len(list_filter(list_distinct_in_order, lambda x: list_contains(dt, x))) > 0""")
def matched_terms(spark, sf_dir):
    """Terms of each query found in each document, by a join on the term rather than on all pairs."""
    q = queries_of(spark, sf_dir).select("item_id", X.without_stop_words(X.tokens(F.col("q"))).alias("qt"))
    places = q.select("item_id", F.posexplode(F.array_distinct("qt")).alias("pos", "term"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    hit = d.join(F.broadcast(places), "term").groupBy("item_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("m"))
    return hit.select("item_id", "doc_id", F.array_join(F.transform("m", lambda x: x["term"]), " ").alias("matched"))


_QSET = """SELECT * FROM (VALUES (1, 'getUserById'), (2, 'how does retry work'), (3, '"exact phrase"'), (4, 'internal/shop/cart.go'), (5, 'ERR_TIMEOUT'), (6, 'search engine'),
 (7, 'E10234'), (8, 'vector index compaction policy'), (9, 'HTTP_SERVER'), (10, 'snake_case_name'), (11, 'ADR-12 storage choice'), (12, 'ParserException'), (13, ''), (14, 'Engine'), (15, 'config error')) AS q(id, q)"""


def fixed_queries(spark):
    return spark.sql(_QSET.replace("(VALUES", "VALUES").replace("(15, 'config error'))", "(15, 'config error')"))


_LEX = f"""(regexp_matches(trim(q), '(?i)\\bADR-\\d+\\b') OR regexp_matches(trim(q), '{X.ERROR_CODE}') OR regexp_matches(trim(q), '{X.QUOTED.replace("'", "''")}') OR regexp_matches(trim(q), '{X.FILE_PATH}')
 OR (NOT contains(trim(q), ' ') AND ({" OR ".join(f"regexp_matches(trim(q), '{p}')" for p in X.IDENTIFIERS)})))"""


@query(f"""WITH c AS (SELECT id, q, CASE WHEN trim(q) = '' THEN 0 WHEN {_LEX} THEN 1 WHEN regexp_matches(trim(q), '{X.NATURAL}') THEN 2
 WHEN len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda w: w <> '')) >= 3 THEN 3 ELSE 0 END AS k FROM ({_QSET}))
SELECT id, q, ['MIXED', 'LEXICAL', 'SEMANTIC', 'SEMANTIC'][k + 1] AS kind, [0.6, 0.9, 0.85, 0.75][k + 1]::DOUBLE AS confidence,
 [0.35, 0.85, 0.2, 0.2][k + 1]::DOUBLE AS keyword_weight, [0.65, 0.15, 0.8, 0.8][k + 1]::DOUBLE AS semantic_weight FROM c""")
def classify_queries(spark, sf_dir):
    return fixed_queries(spark).select("id", "q", X.query_class(F.col("q")).alias("c")).select("id", "q", "c.*")


_SYN_SQL = ", ".join(f"('{t}', {i}, '{s}')" for t, ss in SYNONYMS.items() for i, s in enumerate(ss))


@query(f"""WITH q AS ({SQL_QUERIES}), t AS (SELECT item_id, unnest({SQL_TOKENS.format('q')}) AS term, generate_subscripts({SQL_TOKENS.format('q')}, 1) AS pos FROM q),
f AS (SELECT item_id, term, min(pos) AS pos FROM t GROUP BY 1, 2), s(term, n, syn) AS (VALUES {_SYN_SQL}),
a AS (SELECT item_id, syn, min(pos * 10 + n) AS o FROM f JOIN s USING (term) WHERE n < 3 GROUP BY 1, 2), b AS (SELECT a.* FROM a ANTI JOIN f ON a.item_id = f.item_id AND a.syn = f.term)
SELECT item_id, string_agg(w, ' ' ORDER BY o) AS expanded FROM (SELECT item_id, term AS w, pos AS o FROM f UNION ALL SELECT item_id, syn, 1000 + o FROM b) GROUP BY item_id""")
def expand_queries(spark, sf_dir):
    """Query terms once each, then up to three synonyms a term: a join with the synonym table, which is broadcast."""
    return expansion.expanded(queries_of(spark, sf_dir), "item_id", "q").select(F.col("query").alias("item_id"), F.col("q").alias("expanded"))


@query(f"""WITH d AS (SELECT doc_id, {SQL_PATH} AS path FROM documents)
SELECT doc_id, path, (path LIKE '%\\_test.go' ESCAPE '\\' OR contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '/test/') OR contains(path, '/tests/') OR starts_with(path, 'test/')
 OR starts_with(path, 'tests/') OR regexp_matches(path, '(^|/)test_[^/]*\\.py$') OR regexp_matches(path, '_test\\.py$')) AS is_test,
 (starts_with(path, 'internal/') OR contains(path, '/internal/')) AS is_impl, (starts_with(path, 'cmd/') OR contains(path, '/cmd/')) AS is_wrapper FROM d""")
def path_predicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", path_of().alias("path"))
    p = F.col("path")
    return d.select("doc_id", "path", X.is_test_path(p).alias("is_test"), (p.startswith("internal/") | F.contains(p, F.lit("/internal/"))).alias("is_impl"), (p.startswith("cmd/") | F.contains(p, F.lit("/cmd/"))).alias("is_wrapper"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {SQL_PATH} AS path FROM documents) WHERE starts_with(path || '/', 'docs/src1/') OR starts_with(path || '/', 'internal/')")
def filter_scope(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", path_of().alias("path")).filter(X.in_scope(F.col("path"), ["/docs/src1", "internal/"])).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def filter_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("lang") == "de").select("doc_id", "lang")


@query(f"SELECT doc_id, path FROM (SELECT doc_id, {SQL_PATH} AS path FROM documents) WHERE regexp_matches(path, '^docs/.*$') OR regexp_matches(path, '^(?:.*/)?[^/]*_test\\.go$')")
def filter_globs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", path_of().alias("path"))
    return d.filter(X.any_of(*[F.col("path").rlike(X.glob_regex(g)) for g in ("docs/**", "**/*_test.go")]))


@query("""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark), n AS (SELECT item_id, c, count(*) AS k FROM c GROUP BY 1, 2),
s AS (SELECT item_id, k * 1.0 / sum(k) OVER (PARTITION BY item_id) AS p FROM n) SELECT item_id, round(-sum(p * log2(p)), 6) AS entropy FROM s GROUP BY 1""")
def passage_entropy(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(X.entropy(F.col("text")), 6).alias("entropy"))
