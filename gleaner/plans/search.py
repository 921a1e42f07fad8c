"""Ranked search over documents: keyword, vector, fusion, re-scoring and joins around results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions.joins import BROADCAST_ROWS, bounded, top
from gleaner.functions.text import query_class
from gleaner.operators import bm25, metadata, ranking, vectors
from gleaner.plans.texts import SQL_PATH, SQL_QUERIES, SQL_TERMS, path_of, queries_of
from gleaner.registry import query
from gleaner.session import scratch, table

DEPTH = 20

SQL_BM25 = f"""q AS ({SQL_QUERIES}), qa AS (SELECT item_id AS query, {SQL_TERMS.format('q')} AS t FROM q),
qt AS (SELECT query, n, term, count(*) AS qtf FROM (SELECT query, len(list_distinct(t)) AS n, unnest(t) AS term FROM qa) GROUP BY 1, 2, 3),
dt AS (SELECT doc_id AS id, {SQL_TERMS.format('text')} AS t FROM documents), st AS (SELECT count(*) AS docs, avg(len(t)) AS avgdl FROM dt),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
df AS (SELECT term, CASE WHEN ln((docs - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((docs - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf, any_value(avgdl) AS avgdl FROM tf, st GROUP BY term, docs),
sc AS (SELECT query, id, n, count(*) AS matched, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term) GROUP BY 1, 2, 3),
gated AS (SELECT * FROM (SELECT *, bool_or(matched = n) OVER (PARTITION BY query) AS whole FROM sc) WHERE matched = n OR NOT whole),
kw AS (SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM gated) WHERE rank <= {DEPTH})"""
SQL_KNN = f"""vq AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
vd AS (SELECT query, vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS distance FROM embeddings, vq),
vs AS (SELECT * FROM (SELECT query, id, distance, round(1 - distance / 2, 7) AS score, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM vd) WHERE rank <= {DEPTH})"""
SQL_FUSED = f"""{SQL_BM25}, {SQL_KNN},
fj AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.id, b.id) AS id, a.rank AS keyword_rank, b.rank AS vector_rank, a.score AS keyword_score FROM kw a FULL JOIN vs b ON a.query = b.query AND a.id = b.id),
fm AS (SELECT *, greatest(count(keyword_rank) OVER (PARTITION BY query), count(vector_rank) OVER (PARTITION BY query)) + 1 AS missing FROM fj),
fr AS (SELECT *, 0.35 / (60 + coalesce(keyword_rank, missing)) + 0.65 / (60 + coalesce(vector_rank, missing)) AS raw FROM fm),
fn AS (SELECT *, round(raw::DOUBLE / max(raw::DOUBLE) OVER (PARTITION BY query), 6) AS rrf, keyword_rank IS NOT NULL AND vector_rank IS NOT NULL AS in_both FROM fr),
fused AS (SELECT query, id, rrf, keyword_rank, vector_rank, in_both, keyword_score, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, in_both DESC, coalesce(keyword_score, 0) DESC, id) AS rank FROM fn)"""


_indexes: dict[tuple[str, str], str] = {}


def index_of(spark, sf_dir) -> str:
    """The inverted index of the documents: written once an application, read by every search after that."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = scratch(spark, "terms")
        bm25.build(table(spark, sf_dir, "documents"), "doc_id", "text", path, 16)
        _indexes[key] = path
    return _indexes[key]


def keyword(spark, sf_dir, k: int = DEPTH, mode: str = "and_then_or"):
    """The best documents of each query, written: a query that reads them several times scores them once."""
    found, path = bm25.best_built(spark, index_of(spark, sf_dir), queries_of(spark, sf_dir), "item_id", "q", k, mode), scratch(spark, "keyword")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def vector(spark, sf_dir, k: int = DEPTH, metric: str = "cosine"):
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest(e, e.join(bounded(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))), "vec_id", "left_semi"), k, metric)


def few(spark, sf_dir, results, each: int = 2 * DEPTH):
    """Results of the benchmark's queries, `each` a query at most: marked for broadcast, so that documents joined with them aren't shuffled, while their number is bounded."""
    queries = table(spark, sf_dir, "benchmark").limit(BROADCAST_ROWS // each + 1).count()
    return F.broadcast(results) if queries * each <= BROADCAST_ROWS else results


def fused(spark, sf_dir):
    return ranking.fuse(keyword(spark, sf_dir), vector(spark, sf_dir))


@query(f"WITH dt AS (SELECT {SQL_TERMS.format('text')} AS t FROM documents) SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms, round(avg(len(t)), 6) AS avgdl FROM dt")
def corpus_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.size(bm25.terms_of(F.col("text"))).alias("n"))
    return d.agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.round(F.avg("n"), 6).alias("avgdl"))


@query(f"""WITH dt AS (SELECT doc_id, unnest({SQL_TERMS.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY 1, 2)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM tf GROUP BY 1 ORDER BY df DESC, term LIMIT 100""")
def postings_top_terms(spark, sf_dir):
    p = bm25.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")).orderBy(F.col("df").desc(), "term").limit(100)


@query(f"WITH {SQL_BM25} SELECT query, id, score, rank FROM kw")
def bm25_and_or_topk(spark, sf_dir):
    return keyword(spark, sf_dir)


@query(f"WITH {SQL_BM25} SELECT query, id, score, rank FROM kw")
def bm25_without_index(spark, sf_dir):
    """The same search without an index, in one plan over the texts."""
    return bm25.search(table(spark, sf_dir, "documents"), queries_of(spark, sf_dir), "doc_id", "text", "item_id", "q", DEPTH)


_CHANGED = "CASE WHEN doc_id % 10 = 3 THEN text || ' ' || substr(text, 1, 200) ELSE text END"


@query(f"WITH {SQL_BM25.replace('FROM documents)', f'FROM (SELECT doc_id, {_CHANGED} AS text FROM documents WHERE doc_id % 10 <> 7))')} SELECT query, id, score, rank FROM kw")
def bm25_after_changes(spark, sf_dir):
    """An index that grew by segments: built without some documents, which are added, then others are replaced and others removed.
    The rows are those of an index built anew."""
    d, path, late = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "changed"), F.col("doc_id") % 10
    ids = lambda df: df.select(F.col("doc_id").alias("id"))
    bm25.build(d.filter(late != 5), "doc_id", "text", path, 16)
    bm25.change(spark, path, 1, ids(d.limit(0)), d.filter(late == 5), "doc_id", "text")
    again = d.filter(late == 3)
    bm25.change(spark, path, 2, ids(again), again.withColumn("text", F.expr(_CHANGED)), "doc_id", "text")
    bm25.change(spark, path, 3, ids(d.filter(late == 7)), d.limit(0), "doc_id", "text")
    return bm25.best_built(spark, path, queries_of(spark, sf_dir), "item_id", "q", DEPTH, segment=3)


@query(f"""WITH dt AS (SELECT {SQL_TERMS.format('text')} AS t FROM documents WHERE doc_id % 10 <> 7), u AS (SELECT unnest(t) AS term FROM dt)
SELECT (SELECT count(*) FROM dt) AS docs, round((SELECT avg(len(t)) FROM dt), 6) AS avgdl, (SELECT count(DISTINCT term) FROM u) AS terms, (SELECT count(*) FROM dt WHERE len(t) > 0) AS ids""")
def index_statistics(spark, sf_dir):
    """Documents, mean length, terms and identifiers of an index after a removal."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "statistics")
    bm25.build(d, "doc_id", "text", path, 16)
    bm25.change(spark, path, 1, d.filter("doc_id % 10 = 7").select(F.col("doc_id").alias("id")), d.limit(0), "doc_id", "text")
    s = bm25.statistics(spark, path, 1)
    return s.crossJoin(bm25.all_ids(spark, path, 1).agg(F.count("*").alias("ids"))).select("docs", F.round("avgdl", 6).alias("avgdl"), "terms", "ids")  # one row each


@query(f"WITH {SQL_BM25} SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10")
def bm25_or_topk(spark, sf_dir):
    return keyword(spark, sf_dir, 10, "or")


@query(f"WITH {SQL_KNN} SELECT * FROM vs")
def knn_cosine_topk(spark, sf_dir):
    return vector(spark, sf_dir)


@query(f"""WITH {SQL_KNN}, l AS (SELECT query, vec_id AS id, round(list_distance(embedding::DOUBLE[], qv), 6) AS distance FROM embeddings, vq)
SELECT * FROM (SELECT query, id, distance, round(1 / (1 + distance), 6) AS score, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM l) WHERE rank <= 10""")
def knn_l2_topk(spark, sf_dir):
    return vector(spark, sf_dir, 10, "l2")


@query()
def knn_by_lists(spark, sf_dir):
    """Approximate neighbours; checked for recall against the exact ones in the tests."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest_by_lists(e, e.filter(F.col("vec_id") % 20 == 0), 10)


@query()
def knn_from_lists(spark, sf_dir):
    """The same from lists that were written once, one folder each."""
    e, path = table(spark, sf_dir, "embeddings"), scratch(spark, "lists")
    vectors.build_lists(e, path)
    return vectors.nearest_built(spark, path, e.filter(F.col("vec_id") % 20 == 0), 10)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding)::BIGINT AS dims FROM embeddings")
def vector_norms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.size("embedding").cast("long").alias("dims"))


@query()
def static_embedding(spark, sf_dir):
    return vectors.static_embedding(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {SQL_FUSED} SELECT query, id, rrf, coalesce(keyword_rank, 0) AS keyword_rank, coalesce(vector_rank, 0) AS vector_rank, in_both, rank FROM fused")
def rrf_fusion(spark, sf_dir):
    found = fused(spark, sf_dir)
    return found.select("query", "id", "rrf", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("keyword_rank", "vector_rank")], "in_both", "rank")


@query(f"""WITH {SQL_BM25}, {SQL_KNN}, p AS (SELECT query, id, 0.35 / (60 + rank) AS p FROM kw UNION ALL SELECT query, id, 0.65 / (60 + rank) FROM vs),
s AS (SELECT query, id, round(sum(p::DOUBLE), 8) AS rrf FROM p GROUP BY 1, 2) SELECT query, id, rrf, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, id) AS rank FROM s""")
def rrf_public(spark, sf_dir):
    return ranking.fuse_plain(keyword(spark, sf_dir), vector(spark, sf_dir))


@query(f"""WITH {SQL_BM25}, {SQL_KNN}, r AS (SELECT query, id, rank, 1.0 AS w FROM kw UNION ALL SELECT query, id, rank, 0.8 FROM vs UNION ALL SELECT query, id, rank, 1.5 FROM kw WHERE rank <= 5),
s AS (SELECT query, id, sum(w::DOUBLE / (60 + rank)) * (1 + 0.1 * (count(*) - 1)) AS raw, count(*) AS hits FROM r GROUP BY 1, 2), n AS (SELECT query, id, hits, round(raw / max(raw) OVER (PARTITION BY query), 6) AS rrf FROM s)
SELECT query, id, hits, rrf, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, hits DESC, id) AS rank FROM n""")
def multi_query_rrf(spark, sf_dir):
    """Three weighted sub-rankings of each query in one plan."""
    kw, vs = keyword(spark, sf_dir), vector(spark, sf_dir)
    part = lambda df, sub, w: df.select("query", F.lit(sub).alias("sub"), F.lit(w).alias("weight"), "id", "rank")
    return ranking.fuse_many(part(kw, 1, 1.0).unionByName(part(vs, 2, 0.8)).unionByName(part(kw.filter("rank <= 5"), 3, 1.5)))


_FACTOR = """(CASE WHEN regexp_matches(path, '_test\\.go$|(^|/)test_[^/]*\\.py$|_test\\.py$|\\.test\\.|\\.spec\\.|(^|/)tests?/|(^|/)__tests__/') THEN 0.5 ELSE 1.0 END
 * CASE WHEN regexp_matches(path, '(^|/)internal/') THEN 1.3 ELSE 1.0 END * CASE WHEN regexp_matches(path, '(^|/)cmd/') THEN 0.6 ELSE 1.0 END)::DOUBLE"""
_META_CASES = """CASE WHEN regexp_matches(path, '^archive/') THEN 'archived' WHEN regexp_matches(path, '\\.log$') THEN 'raw_evidence' WHEN regexp_matches(path, '^docs/reference/decisions/ADR-[^/]*\\.md$') THEN 'adr'
 WHEN regexp_matches(path, '^docs/') THEN 'docs' WHEN regexp_matches(path, '_test\\.(go|py)$|(^|/)test_[^/]*\\.py$') THEN 'test' WHEN regexp_matches(path, '\\.(go|ts|js|py)$') THEN 'source_code'
 WHEN regexp_matches(path, '\\.(md|pdf)$') THEN 'docs' ELSE 'unknown' END"""
SQL_META = f"""dp AS (SELECT *, {SQL_PATH} AS path FROM documents), dm AS (SELECT *, {_META_CASES} AS source_class FROM dp),
da AS (SELECT *, CASE source_class WHEN 'archived' THEN 'archived' WHEN 'raw_evidence' THEN 'raw_evidence' WHEN 'adr' THEN 'unknown' WHEN 'unknown' THEN 'unknown' ELSE 'active' END AS authority,
 CASE source_class WHEN 'archived' THEN 'archive' WHEN 'raw_evidence' THEN 'review_corpus' WHEN 'test' THEN 'code' WHEN 'source_code' THEN 'code' ELSE 'project_memory' END AS profile, source_class = 'archived' AS stale FROM dm),
meta AS (SELECT *, CASE authority WHEN 'active' THEN 80 WHEN 'unknown' THEN 45 WHEN 'raw_evidence' THEN 20 ELSE 10 END - CASE WHEN stale THEN 20 ELSE 0 END AS priority FROM da)"""


def with_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", path_of()).withColumn("meta", metadata.source_metadata(F.col("path")))
    return d.withColumn("priority", metadata.priority(F.col("meta")))


@query(f"WITH {SQL_META} SELECT doc_id, path, source_class, authority, profile, stale, priority FROM meta")
def source_metadata(spark, sf_dir):
    return with_metadata(spark, sf_dir).select("doc_id", "path", "meta.source_class", "meta.authority", "meta.profile", "meta.stale", "priority")


@query(f"WITH {SQL_META} SELECT profile, source_class, count(*) AS n, sum(CASE WHEN source_class IN ('docs', 'adr', 'unknown') AND NOT stale THEN 1 ELSE 0 END)::BIGINT AS eligible FROM meta GROUP BY 1, 2")
def profile_mismatch(spark, sf_dir):
    """How many documents of each profile and class a project-memory search may return."""
    m = with_metadata(spark, sf_dir)
    ok = F.col("meta.source_class").isin("docs", "adr", "unknown") & ~F.col("meta.stale")
    return m.groupBy(F.col("meta.profile").alias("profile"), F.col("meta.source_class").alias("source_class")).agg(F.count("*").alias("n"), F.count_if(ok).alias("eligible"))


@query(f"WITH {SQL_META} SELECT doc_id FROM meta WHERE source_class = 'adr' AND NOT stale")
def filter_decisions(spark, sf_dir):
    return with_metadata(spark, sf_dir).filter((F.col("meta.source_class") == "adr") & ~F.col("meta.stale") & ~F.col("meta.generated")).select("doc_id")


@query(f"WITH {SQL_FUSED}, dp AS (SELECT doc_id, {SQL_PATH} AS path FROM documents) SELECT query, id, path, round(rrf * {_FACTOR}, 6) AS score FROM fused JOIN dp ON doc_id = id")
def boost_chain(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path_of().alias("path"))
    return few(spark, sf_dir, fused(spark, sf_dir)).join(d, "id").select("query", "id", "path", F.round(F.col("rrf") * ranking.path_factor(F.col("path")), 6).alias("score"))


@query(f"""WITH {SQL_FUSED}, {SQL_META}, x AS (SELECT query, id, rrf, path, string_split(text, ' ')[1] AS head FROM fused JOIN dp ON doc_id = id)
SELECT query, id, round(rrf * CASE WHEN path = (SELECT min({SQL_PATH}) FROM documents WHERE doc_id = x.query) THEN 4.0 WHEN head = 'The' THEN 4.0 ELSE 1.0 END, 6) AS score FROM x""")
def exact_match_boost(spark, sf_dir):
    """Queries that are a path or a symbol: here the path of the document numbered like the query, and a first word as symbol."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path_of().alias("path"), F.split("text", " ")[0].alias("head"))
    wanted = d.join(bounded(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))), "id", "left_semi").select(F.col("id").alias("query"), F.col("path").alias("needle"))
    x = few(spark, sf_dir, fused(spark, sf_dir)).join(d, "id").join(bounded(wanted), "query", "left")
    by_path = ranking.exact_factor(F.col("path"), F.lit(""), F.array().cast("array<string>"), F.coalesce("needle", F.lit("\0")), F.lit(False))
    by_symbol = ranking.exact_factor(F.lit(""), F.lit(""), F.array("head"), F.lit("The"), F.lit(False))
    return x.select("query", "id", F.round(F.col("rrf") * F.when(by_path > 1, by_path).otherwise(by_symbol), 6).alias("score"))


@query(f"""WITH {SQL_FUSED}, {SQL_META} SELECT query, id, rrf AS score, row_number() OVER (PARTITION BY query ORDER BY round(rrf + priority / 100.0::DOUBLE * 0.12, 6) DESC, rank, id) AS position
FROM fused JOIN meta ON doc_id = id""")
def authority_order(spark, sf_dir):
    m = with_metadata(spark, sf_dir).select(F.col("doc_id").alias("id"), "priority")
    x = few(spark, sf_dir, fused(spark, sf_dir)).join(m, "id")
    order = Window.partitionBy("query").orderBy(F.round(ranking.authority_key(F.col("rrf"), F.col("priority")), 6).desc(), "rank", "id")
    return x.select("query", "id", F.col("rrf").alias("score"), F.row_number().over(order).cast("long").alias("position"))


@query(f"""WITH {SQL_FUSED}, {SQL_META}, x AS (SELECT query, id, round(rrf * {_FACTOR}, 6) AS score, priority, path, source_class, rank, length(text) AS chars FROM fused JOIN meta ON doc_id = id WHERE NOT stale),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score + priority / 100.0::DOUBLE * 0.12, 6) DESC, rank, id) AS position FROM x)
SELECT query, id, score, path, source_class, chars, position FROM o WHERE position <= 10""")
def search_flagship(spark, sf_dir):
    """Keyword and vector retrieval, fusion, metadata filter, path re-scoring, authority order, top ten a query."""
    m = with_metadata(spark, sf_dir).filter(~F.col("meta.stale")).select(F.col("doc_id").alias("id"), "path", "priority", F.col("meta.source_class").alias("source_class"), F.length("text").cast("long").alias("chars"))
    x = few(spark, sf_dir, fused(spark, sf_dir)).join(m, "id").withColumn("score", F.round(F.col("rrf") * ranking.path_factor(F.col("path")), 6))
    key = F.round(ranking.authority_key(F.col("score"), F.col("priority")), 6)
    return top(x.drop("rrf").withColumn("key", key), 10, ["query"], F.col("key").desc(), F.col("rank"), F.col("id"), rank="position").select("query", "id", "score", "path", "source_class", "chars", "position")


@query(f"""WITH {SQL_BM25}, c AS (SELECT item_id, q, contains(q, 'the') AS natural FROM q), w AS (SELECT query, id, rank, CASE WHEN len(string_split(q, ' ')) >= 3 THEN 0.2 ELSE 0.35 END AS kw FROM kw JOIN c ON item_id = query)
SELECT query, id, round(kw::DOUBLE / (60 + rank), 8) AS part FROM w""")
def classified_weights(spark, sf_dir):
    """The opt-in classifier as a column: each query's own keyword weight in the fused score."""
    q = queries_of(spark, sf_dir).select(F.col("item_id").alias("query"), query_class(F.col("q")).alias("c"))
    return keyword(spark, sf_dir).join(bounded(q), "query").select("query", "id", F.round(F.col("c.keyword_weight") / (60 + F.col("rank")), 8).alias("part"))


@query(f"""WITH {SQL_BM25}, f AS (SELECT query, id, rank, source FROM kw JOIN documents ON doc_id = id), p AS (SELECT query, source, min(rank) AS best FROM f GROUP BY 1, 2),
c AS (SELECT p.query, doc_id AS id, row_number() OVER (PARTITION BY p.query, source ORDER BY n_chars DESC, doc_id) AS n FROM p JOIN documents USING (source) WHERE best <= 3), t AS (SELECT query, max(score) AS top FROM kw GROUP BY 1)
SELECT c.query, c.id, t.top AS score FROM c JOIN t USING (query) WHERE n <= 2 AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.query = c.query AND kw.id = c.id)""")
def append_candidates(spark, sf_dir):
    """Two more documents of each of the best paths, unless the results have them, at the score of the best result."""
    kw, d = keyword(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    best = few(spark, sf_dir, kw.filter("rank <= 3"), 3).join(d.select("id", "source"), "id").select("query", "source").distinct()
    two = top(d, 2, ["source"], F.col("n_chars").desc(), F.col("id"), rank="n").select("source", "id")
    return best.join(two, "source").join(kw, ["query", "id"], "left_anti").join(kw.groupBy("query").agg(F.max("score").alias("score")), "query").select("query", "id", "score")


@query("""WITH h AS (SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(text, 'the')), p AS (SELECT h.conv_id, h.turn, c.turn AS other, c.text FROM h JOIN conversations c USING (conv_id) WHERE c.turn <> h.turn)
SELECT conv_id, turn, other, other - turn AS gap FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, other > turn ORDER BY abs(other - turn)) AS n FROM p) WHERE n <= 2""")
def adjacent_context(spark, sf_dir):
    """The two nearest turns before and after each hit, by lead and lag: one shuffle on the conversation, no self join."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = F.filter(F.array(*[F.lag("turn", i).over(w) for i in (1, 2)], *[F.lead("turn", i).over(w) for i in (1, 2)]), lambda t: t.isNotNull())
    hits = c.withColumn("near", near).filter((F.col("role") == "user") & F.contains("text", F.lit("the")))
    return hits.select("conv_id", "turn", F.explode("near").alias("other")).withColumn("gap", F.col("other") - F.col("turn"))


@query(f"""WITH {SQL_BM25} SELECT query, id, len(list_filter(generate_series(1, length(text)), lambda i: lower(substr(text, i, 3)) = 'the'))::BIGINT AS hits FROM kw JOIN documents ON doc_id = id WHERE rank <= 3""")
def highlights(spark, sf_dir):
    """How often a term is found in a result, by character offsets."""
    found = few(spark, sf_dir, keyword(spark, sf_dir, 3), 3).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return found.select("query", "id", F.regexp_count(F.lower("text"), F.lit("the")).cast("long").alias("hits"))
