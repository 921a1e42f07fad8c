"""Telemetry, retrieval evaluation, table maintenance and log analysis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner import engine
from gleaner.functions.joins import top
from gleaner.functions.text import tokens
from gleaner.operators import code, quantiles, ranking
from gleaner.plans.search import SQL_FUSED, keyword, vector
from gleaner.plans.texts import SQL_PATH, SQL_TOKENS, path_of
from gleaner.registry import query
from gleaner.session import table
from gleaner.sources.files import IgnoreRules

# --- telemetry: events stand for query events; value is the latency in ms, k in props the number of results

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def results_of(props):
    return F.get_json_object(props, "$.k").cast("long")


@query("""SELECT event_type, CASE WHEN value < 10 THEN '<10' WHEN value < 50 THEN '<50' WHEN value < 100 THEN '<100' WHEN value < 500 THEN '<500' ELSE '>=500' END AS bucket, count(*) AS n FROM events GROUP BY 1, 2""")
def latency_histogram(spark, sf_dir):
    v = F.col("value")
    bucket = F.when(v < 10, "<10").when(v < 50, "<50").when(v < 100, "<100").when(v < 500, "<500").otherwise(">=500")
    return table(spark, sf_dir, "events").groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def query_type_by_day(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM benchmark) SELECT term, count(*) AS n FROM w WHERE length(term) >= 3 GROUP BY 1 ORDER BY n DESC, term LIMIT 50""")
def top_query_terms(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("term")).filter(F.length("term") >= 3)
    return w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(50)


@query(f"SELECT event_type, count(*) AS n, sum(CASE WHEN {_K} = 0 THEN 1 ELSE 0 END)::BIGINT AS zero, round(100.0 * avg(CASE WHEN {_K} = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_pct FROM events GROUP BY 1")
def zero_result_rate(spark, sf_dir):
    zero = results_of(F.col("props")) == 0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(zero).alias("zero"), F.round(100.0 * F.avg(zero.cast("double")), 6).alias("zero_pct"))


@query(f"""SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events WHERE {_K} = 0) WHERE n <= 20""")
def latest_zero_results(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(results_of(F.col("props")) == 0)
    return top(e, 20, ["event_type"], F.col("ts").desc(), F.col("event_id")).select("event_type", "event_id")


@query(f"""WITH q AS (SELECT user_id, event_id, sha256(event_type || '|' || {_K}) AS h, ts FROM events), r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, h ORDER BY ts, event_id) > 1 AS again FROM q)
SELECT user_id, count(*) AS n, sum(CASE WHEN again THEN 1 ELSE 0 END)::BIGINT AS repeats FROM r GROUP BY 1""")
def exact_repeat_rate(spark, sf_dir):
    """Queries that a user has asked before: all but the first of each hash, so counts suffice and nothing is sorted."""
    q = table(spark, sf_dir, "events").select("user_id", F.sha2(F.concat_ws("|", "event_type", results_of(F.col("props")).cast("string")), 256).alias("h"))
    per = q.groupBy("user_id", "h").agg(F.count("*").alias("c"))
    return per.groupBy("user_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("repeats"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = ceil(n * 0.5) THEN value END) AS p50, max(CASE WHEN i = ceil(n * 0.95) THEN value END) AS p95 FROM r GROUP BY 1""")
def nearest_rank_percentiles(spark, sf_dir):
    return quantiles.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type, count(*) AS n, round(max(value), 6) AS slowest FROM events GROUP BY 1, 2")
def telemetry_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("slowest"))
    return e.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "slowest")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS events FROM s GROUP BY 1""")
def debounce_sessions(spark, sf_dir):
    """Quiet-window batches of each user: a batch ends after two hours without an event."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


# --- evaluation: labels are judgements of documents, results are the fused and the keyword rankings

SQL_RUNS = f"""{SQL_FUSED}, runs AS (SELECT 'hybrid' AS mode, query, id, rank FROM fused WHERE rank <= 10 UNION ALL SELECT 'keyword', query, id, rank FROM kw WHERE rank <= 10),
judged AS (SELECT mode, query, query % 4 AS class, rank, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS grade FROM runs JOIN labels ON doc_id = id),
perq AS (SELECT mode, query, class, min(CASE WHEN grade >= 2 THEN rank END) AS first, sum((power(2, grade) - 1) / log2(rank + 1)) AS dcg, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END)::BIGINT AS useful FROM judged GROUP BY 1, 2, 3)"""


def judged(spark, sf_dir):
    cut = lambda df, mode: df.filter("rank <= 10").select(F.lit(mode).alias("mode"), "query", "id", "rank")
    kw = keyword(spark, sf_dir)
    runs = cut(ranking.fuse(kw, vector(spark, sf_dir)), "hybrid").unionByName(cut(kw, "keyword"))
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0)
    return runs.join(table(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id")).select("mode", "query", (F.col("query") % 4).alias("class"), "rank", grade.alias("grade"))


def per_query(spark, sf_dir):
    useful = F.col("grade") >= 2
    dcg = F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0))
    return judged(spark, sf_dir).groupBy("mode", "query", "class").agg(F.min(F.when(useful, F.col("rank"))).alias("first"), dcg.alias("dcg"), F.count_if(useful).alias("useful"))


def _metrics():
    return [
        F.count("*").alias("n"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("pass_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg((F.coalesce("first", F.lit(99)) <= 5).cast("double")), 6).alias("hit5"), F.round(F.avg("dcg"), 6).alias("dcg"),
    ]


_SQL_METRICS = """count(*) AS n, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr,
 round(avg(CASE WHEN coalesce(first, 99) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5, round(avg(dcg), 6) AS dcg"""


@query(f"WITH {SQL_RUNS} SELECT mode, {_SQL_METRICS} FROM perq GROUP BY 1")
def ir_metrics(spark, sf_dir):
    return per_query(spark, sf_dir).groupBy("mode").agg(*_metrics())


@query(f"WITH {SQL_RUNS} SELECT coalesce(mode, 'all') AS mode, coalesce(class, -1) AS class, {_SQL_METRICS} FROM perq GROUP BY GROUPING SETS ((mode, class), (mode), (class), ())")
def grouped_metrics(spark, sf_dir):
    """All groupings in one pass over the judged results."""
    p = per_query(spark, sf_dir)
    g = p.groupingSets([["mode", "class"], ["mode"], ["class"], []], "mode", "class").agg(*_metrics())
    return g.withColumn("mode", F.coalesce("mode", F.lit("all"))).withColumn("class", F.coalesce("class", F.lit(-1)))


@query(f"""WITH {SQL_RUNS}, m AS (SELECT mode, class, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM perq GROUP BY 1, 2)
SELECT class, a.mrr AS base, b.mrr AS now, round(b.mrr - a.mrr, 6) AS delta, b.mrr - a.mrr < -0.05 AS regressed FROM m a JOIN m b USING (class) WHERE a.mode = 'keyword' AND b.mode = 'hybrid'""")
def metric_gates(spark, sf_dir):
    """Each class against its baseline."""
    m = per_query(spark, sf_dir).groupBy("mode", "class").agg(F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
    p = m.groupBy("class").pivot("mode", ["keyword", "hybrid"]).agg(F.first("mrr")).filter("keyword is not null and hybrid is not null")
    delta = F.col("hybrid") - F.col("keyword")
    return p.select("class", F.col("keyword").alias("base"), F.col("hybrid").alias("now"), F.round(delta, 6).alias("delta"), (delta < -0.05).alias("regressed"))


@query("""WITH r AS (SELECT item_id, item_id % 12 AS class, row_number() OVER (PARTITION BY item_id % 12 ORDER BY item_id) AS n FROM benchmark), o AS (SELECT *, row_number() OVER (ORDER BY n > 1, item_id) AS pos FROM r)
SELECT item_id, class FROM o WHERE pos <= 15""")
def quick_subset(spark, sf_dir):
    """First query of each class, filled up to fifteen."""
    q = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 12).alias("class"))
    q = q.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("item_id")))
    return q.orderBy(F.col("n") > 1, "item_id").limit(15).select("item_id", "class")


# --- maintenance: two versions of the document table stand for a stored index and the current files

_OLD = f"SELECT doc_id, {SQL_PATH} AS path, n_chars AS size FROM documents WHERE source <> 'src3'"
_NEW = f"SELECT doc_id, {SQL_PATH} AS path, n_chars + CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS size FROM documents WHERE source <> 'src7'"


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM o FULL JOIN n USING (doc_id) WHERE o.path IS NULL OR n.path IS NULL OR o.size <> n.size""")
def change_detection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", path_of())
    old = d.filter("source <> 'src3'").select("doc_id", F.col("path").alias("old"), F.col("n_chars").alias("old_size"))
    new = d.filter("source <> 'src7'").select("doc_id", F.col("path").alias("new"), (F.col("n_chars") + (F.col("lang") == "es").cast("int")).alias("new_size"))
    both = old.join(new, "doc_id", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old_size") != F.col("new_size"), "modified")
    return both.select(F.coalesce("old", "new").alias("path"), change.alias("change")).filter("change is not null")


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT path, size, 'kept' AS origin FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT path, size, 'new' FROM n""")
def upsert_files(spark, sf_dir):
    """Stored rows without a newer version, and the new rows: anti join and union."""
    d = table(spark, sf_dir, "documents").withColumn("path", path_of())
    old = d.filter("source <> 'src3'").select("path", F.col("n_chars").alias("size"), F.lit("kept").alias("origin"))
    new = d.filter("source <> 'src7'").select("path", (F.col("n_chars") + (F.col("lang") == "es").cast("int")).alias("size"), F.lit("new").alias("origin"))
    return old.join(new.select("path"), "path", "left_anti").unionByName(new)


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def upsert_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src5')")
def delete_cascade(spark, sf_dir):
    """Rows that stay in a child table when a project's files go."""
    gone = table(spark, sf_dir, "documents").filter("source = 'src5'").select("doc_id")
    return table(spark, sf_dir, "labels").join(gone, "doc_id", "left_anti").select("doc_id", "quality")


@query(f"""WITH m AS (SELECT doc_id AS id FROM documents), k AS (SELECT doc_id AS id FROM documents WHERE len({SQL_TOKENS.format('text')}) >= 20), v AS (SELECT vec_id AS id FROM embeddings)
SELECT 'missing_keyword' AS issue, id FROM m WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT 'missing_vector', id FROM m WHERE id NOT IN (SELECT id FROM v) UNION ALL SELECT 'orphan_vector', id FROM v WHERE id NOT IN (SELECT id FROM m)""")
def consistency_check(spark, sf_dir):
    """Metadata against keyword index and vectors: anti joins with a label."""
    d = table(spark, sf_dir, "documents")
    m, v = d.select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    k = d.filter(F.size(tokens(F.col("text"))) >= 20).select(F.col("doc_id").alias("id"))
    lost = lambda a, b, label: a.join(b, "id", "left_anti").select(F.lit(label).alias("issue"), "id")
    return lost(m, k, "missing_keyword").unionByName(lost(m, v, "missing_vector")).unionByName(lost(v, m, "orphan_vector"))


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars, max(n_chars) AS largest, count(DISTINCT lang) AS langs FROM documents GROUP BY 1")
def project_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("largest"), F.count_distinct("lang").alias("langs"))


@query(f"SELECT path FROM (SELECT {SQL_PATH} AS path FROM documents) ORDER BY path LIMIT 101 OFFSET 100")
def list_page(spark, sf_dir):
    """One page of a listing by path and one more row, which tells that there are more."""
    return table(spark, sf_dir, "documents").select(path_of().alias("path")).orderBy("path").offset(100).limit(101)


@query("""WITH g AS (SELECT label % 4 AS list, count(*) AS total, sum(CASE WHEN vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN 1 ELSE 0 END)::BIGINT AS orphans FROM embeddings GROUP BY 1)
SELECT list, total, orphans, orphans >= 100 AND orphans >= 0.2 * total AND list * 20 >= 30 AND list * 2000 >= 3600 AS compact FROM g""")
def compaction_trigger(spark, sf_dir):
    """Which vector lists are due for a rewrite, their numbers standing for idle time and the time since the last one."""
    live = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("live"))
    v = table(spark, sf_dir, "embeddings").withColumn("list", F.col("label") % 4).join(live, "vec_id", "left").groupBy("list").agg(F.count("*").alias("total"), F.count_if(F.col("live").isNull()).alias("orphans"))
    return v.withColumn("compact", engine.compaction_due(F.col("orphans"), F.col("orphans") / F.col("total"), F.col("list") * 20, F.col("list") * 2000))


@query(r"""WITH p AS (SELECT page_id, ltrim(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '/') AS path FROM pages)
SELECT page_id, path, CASE WHEN regexp_matches(path, '^en/15(/.*)?$') THEN false WHEN regexp_matches(path, '^(.*/)?fr/.*$') THEN true WHEN regexp_matches(path, '^(.*/)?[^/]*5(/.*)?$') THEN true ELSE false END AS ignored FROM p""")
def ignore_rules(spark, sf_dir):
    """Ordered rules, the last that matches decides, negation included: one expression."""
    p = table(spark, sf_dir, "pages").select("page_id", F.ltrim(F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1), F.lit("/")).alias("path"))
    return p.select("page_id", "path", IgnoreRules(["# rules", "*5", "fr/", "!en/15"]).ignored(F.col("path")).alias("ignored"))


@query(f"""WITH p AS (SELECT doc_id, regexp_extract({SQL_PATH}, '\\.([^./]+)$', 1) AS ext FROM documents) SELECT doc_id, CASE ext WHEN 'go' THEN 'go' WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python' ELSE 'text' END AS language,
 CASE WHEN ext IN ('go', 'py') THEN 'code' WHEN ext = 'md' THEN 'markdown' ELSE 'text' END AS content_type FROM p""")
def file_languages(spark, sf_dir):
    lang = code.language(path_of())
    return table(spark, sf_dir, "documents").select("doc_id", lang.alias("language"), code.content_type(lang).alias("content_type"))


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1""")
def first_occurrence(spark, sf_dir):
    """The first of equal keys in order: a grouped minimum."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn")).select("conv_id", "turn")


# --- logs and benchmarks

@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), f AS (SELECT event_id, user_id, ts FROM t WHERE n <= 20 AND event_type IN ('error', 'purchase'))
SELECT event_id, user_id FROM f ORDER BY ts DESC, event_id LIMIT 100""")
def log_tail(spark, sf_dir):
    """Last lines of each source, then the level filter, then the last of all by time."""
    t = top(table(spark, sf_dir, "events"), 20, ["user_id"], F.col("ts").desc(), F.col("event_id").desc())
    return t.filter(F.col("event_type").isin("error", "purchase")).orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "user_id")


@query("""WITH m AS (SELECT event_type, ts >= TIMESTAMP '2024-01-16' AS now, avg(value) AS v FROM events GROUP BY 1, 2) SELECT a.event_type, round(a.v, 6) AS base, round(b.v, 6) AS now, b.v > a.v * 1.02 AS regressed
FROM m a JOIN m b USING (event_type) WHERE NOT a.now AND b.now""")
def bench_compare(spark, sf_dir):
    """Means before and after a date, flagged beyond a threshold: one pass with conditional aggregates."""
    after = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.when(~after, F.col("value"))).alias("a"), F.avg(F.when(after, F.col("value"))).alias("b"))
    return m.filter("a is not null and b is not null").select("event_type", F.round("a", 6).alias("base"), F.round("b", 6).alias("now"), (F.col("b") > F.col("a") * 1.02).alias("regressed"))
