"""Result presentation, gates and small merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import graph, ranking, results
from gleaner.plans.graphs import SQL_EDGES, edges
from gleaner.plans.operations import SQL_RUNS, per_query
from gleaner.plans.search import SQL_FUSED, few, fused, keyword
from gleaner.plans.texts import _LEX, _QSET, SQL_PATH, fixed_queries, path_of
from gleaner.registry import query
from gleaner.session import table


@query(r"""SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(q, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> ''), ' ') AS toks
FROM (VALUES (1, 'getUserById'), (2, 'how does retry work'), (3, 'snake_case_name'), (4, 'HTTPServer x9Y')) AS v(id, q)""")
def query_tokens(spark, sf_dir):
    q = spark.sql("SELECT * FROM VALUES (1, 'getUserById'), (2, 'how does retry work'), (3, 'snake_case_name'), (4, 'HTTPServer x9Y') AS v(id, q)")
    return q.select("id", F.array_join(results.query_tokens(F.col("q")), " ").alias("toks"))


@query(f"""WITH {SQL_FUSED}, d AS (SELECT doc_id, {SQL_PATH} AS path, text FROM documents)
SELECT query, 'sr1_' || substr(sha256(query || '|' || path || '|' || id), 1, 24) AS result_id, path, substr(trim(text), 1, 160) AS snippet,
 CASE WHEN in_both THEN 'keyword and semantic match' WHEN keyword_rank IS NOT NULL THEN 'keyword match' ELSE 'semantic match' END AS reason, rank FROM fused JOIN d ON doc_id = id WHERE rank <= 5""")
def search_output(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path_of().alias("path"), "text")
    r = few(spark, sf_dir, fused(spark, sf_dir).filter("rank <= 5"), 5).join(d, "id")
    rid = results.result_id(F.col("query").cast("string"), F.col("path"), F.col("id").cast("string"))
    return r.select("query", rid.alias("result_id"), "path", results.snippet(F.col("text")).alias("snippet"), results.match_reason(F.col("in_both"), F.coalesce("keyword_rank", F.lit(0))).alias("reason"), "rank")


@query(f"""WITH {SQL_FUSED} SELECT query, id, CASE WHEN rank = 1 THEN 'keyword ' || coalesce(keyword_rank, 0) || ', vector ' || coalesce(vector_rank, 0) || ', both ' || CASE WHEN in_both THEN 'true' ELSE 'false' END END AS explain, rank FROM fused WHERE rank <= 3""")
def explain_payload(spark, sf_dir):
    """How the first result of each query came about."""
    said = F.concat(F.lit("keyword "), F.coalesce("keyword_rank", F.lit(0)).cast("string"), F.lit(", vector "), F.coalesce("vector_rank", F.lit(0)).cast("string"), F.lit(", both "), F.col("in_both").cast("string"))
    return fused(spark, sf_dir).filter("rank <= 3").select("query", "id", F.when(F.col("rank") == 1, said).alias("explain"), "rank")


@query()
def highlight_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return few(spark, sf_dir, keyword(spark, sf_dir, 5), 5).join(d, "id").select("query", "id", results.highlight_spans(F.col("text"), F.array(F.lit("the"), F.lit("and"))).alias("spans"))


@query(f"""WITH {SQL_EDGES}, o AS (SELECT src AS a, dst AS b, confidence AS c FROM edges WHERE kind = 'ordered_by'), h AS (SELECT src AS b, dst AS n, confidence AS d FROM edges WHERE kind = 'lives_in')
SELECT a || ' -[ordered_by]-> ' || b || ' -[lives_in]-> ' || n AS path, CASE WHEN least(c, d) >= 1 THEN 'exact' WHEN least(c, d) >= 0.9 THEN 'high' WHEN least(c, d) >= 0.7 THEN 'medium' ELSE 'low' END AS label, 'place,buyer' AS roles FROM o JOIN h USING (b)""")
def path_explanations(spark, sf_dir):
    """Two-hop paths from orders, explained, with their weakest link and roles."""
    e = edges(spark, sf_dir).filter(F.col("kind").isin("ordered_by", "lives_in"))
    seeds = table(spark, sf_dir, "orders").select(graph.node_id("orders", F.col("o_orderkey")).alias("seed"))
    p = graph.paths(e, seeds, 2).filter(F.size("kinds") == 2)
    return p.select(results.path_text(F.col("path"), F.col("kinds")).alias("path"), results.weakest_label(F.col("weakest")).alias("label"), F.array_join(results.roles(F.col("kinds")), ",").alias("roles"))


@query(f"""WITH {SQL_RUNS}, r AS (SELECT class, mode, 100 * avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END) AS recall FROM perq GROUP BY 1, 2), l AS (SELECT a.class, round(b.recall - a.recall, 4) AS lift FROM r a JOIN r b USING (class) WHERE a.mode = 'keyword' AND b.mode = 'hybrid')
SELECT class, lift::DOUBLE AS lift, CASE WHEN lift >= 15 THEN 'keep' WHEN lift >= 10 THEN 'tune' WHEN lift >= 0 THEN 'defer' ELSE 'kill' END AS verdict FROM l""")
def recall_gate(spark, sf_dir):
    r = per_query(spark, sf_dir).groupBy("class").pivot("mode", ["keyword", "hybrid"]).agg(100 * F.avg(F.col("first").isNotNull().cast("double"))).filter("keyword is not null and hybrid is not null")
    return r.select("class", F.round(F.col("hybrid") - F.col("keyword"), 4).alias("lift")).withColumn("verdict", results.recall_gate(F.col("lift")))


@query(f"""WITH {SQL_RUNS}, x AS (SELECT mode, query, sum(CASE WHEN grade >= 2 AND rank <= 3 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN grade >= 2 AND rank <= 5 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) AS c FROM judged GROUP BY 1, 2)
SELECT mode, round(avg(a / 3.0::DOUBLE), 6) AS p3, round(avg(b / 5.0::DOUBLE), 6) AS p5, round(avg(c / 10.0::DOUBLE), 6) AS p10, round(avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit3 FROM x GROUP BY 1""")
def precision_at_k(spark, sf_dir):
    from gleaner.plans.operations import judged

    good = lambda k: F.count_if((F.col("grade") >= 2) & (F.col("rank") <= k))
    x = judged(spark, sf_dir).groupBy("mode", "query").agg(good(3).alias("a"), good(5).alias("b"), good(10).alias("c"))
    return x.groupBy("mode").agg(F.round(F.avg(F.col("a") / 3), 6).alias("p3"), F.round(F.avg(F.col("b") / 5), 6).alias("p5"), F.round(F.avg(F.col("c") / 10), 6).alias("p10"), F.round(F.avg((F.col("a") > 0).cast("double")), 6).alias("hit3"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey LIMIT 50")
def symbol_search(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.contains(F.lower("p_name"), F.lit("ring"))).orderBy("p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


@query("""SELECT p_brand, min(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END)::INTEGER AS kind_rank, min(p_size)::INTEGER AS first_line FROM part WHERE p_name = 'small ring' GROUP BY 1 ORDER BY 2, 3, 1 LIMIT 20""")
def chunks_by_symbol(spark, sf_dir):
    """Holders of a symbol, best kind and earliest line first."""
    kind = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "SMALL", 1).otherwise(2)
    g = table(spark, sf_dir, "part").filter(F.col("p_name") == "small ring").groupBy("p_brand").agg(F.min(kind).alias("kind_rank"), F.min("p_size").alias("first_line"))
    return g.orderBy("kind_rank", "first_line", "p_brand").limit(20)


_BENCH = "SELECT * FROM VALUES (1, 'BenchmarkA-8 100 250.5 ns/op'), (2, 'ok'), (3, 'BenchmarkB 5 10 ns/op 3 B/op'), (4, 'BenchmarkA-8 100 300 ns/op') AS b(n, line)"


@query("SELECT 'BenchmarkA' AS name, 300.0::DOUBLE AS ns UNION ALL SELECT 'BenchmarkB', 10.0")
def bench_log(spark, sf_dir):
    return results.bench_lines(spark.sql(_BENCH), "line", "n")


@query("SELECT 'code' AS name, 'a,b,c' AS include, 'x,y' AS classes UNION ALL SELECT 'docs', 'd', 'z'")
def profile_merge(spark, sf_dir):
    p = spark.createDataFrame([(1, "code", ["a", "b"], ["x"]), (2, "code", ["b", "c"], ["y", "x"]), (1, "docs", ["d"], ["z"])], "pos int, name string, include array<string>, classes array<string>")
    m = results.merged_profiles(p, "name", ("include", "classes"))
    return m.select("name", F.array_join("include", ",").alias("include"), F.array_join("classes", ",").alias("classes"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) > 0 AS unit FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def vector_upsert(spark, sf_dir):
    """Vectors replaced by themselves, those of rejected documents removed; all of unit length."""
    e = table(spark, sf_dir, "embeddings")
    gone = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("vec_id"))
    v, _ = results.put_vectors(e, e, gone, 64)
    return v.select("vec_id", (F.abs(F.sqrt(F.aggregate(F.transform("embedding", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)) - 1) < 1e-6).alias("unit"))


@query(f"""SELECT id, q, CASE WHEN trim(q) = '' THEN 0 WHEN {_LEX} THEN 100 ELSE 20 END AS candidates, CASE WHEN trim(q) = '' THEN 0 ELSE 50 END AS filtered FROM ({_QSET} UNION ALL SELECT item_id + 100, text FROM benchmark)""")
def candidate_limits(spark, sf_dir):
    """How many candidates each query fetches, without and with filters."""
    q = fixed_queries(spark).unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 100).alias("id"), F.col("text").alias("q")))
    return q.select("id", "q", ranking.candidate_depth(F.col("q"), 10).alias("candidates"), ranking.candidate_depth(F.col("q"), 3, True).alias("filtered"))


@query(f"""WITH d AS (SELECT event_id, user_id, event_type, ts FROM events) SELECT event_id FROM d WHERE event_type IN ('error', 'purchase') AND regexp_matches(event_type || ' ' || user_id, '^error .*7')""")
def log_pattern(spark, sf_dir):
    """Lines of a log of a level that a pattern finds."""
    lines = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("level"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("line"))
    return results.log_lines(lines, "^error .*7", ("error", "purchase")).select("event_id")
