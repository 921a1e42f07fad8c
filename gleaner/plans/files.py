"""Queries over a synthetic code corpus and further joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner import engine
from gleaner.operators import code
from gleaner.plans.search import SQL_BM25, keyword
from gleaner.plans.texts import SQL_PATH, path_of
from gleaner.registry import query
from gleaner.session import table
from gleaner.sources import corpus


def generated(spark, sf_dir):
    """As many files as there are documents."""
    return corpus.generate(spark, table(spark, sf_dir, "documents").count())


@query()
def code_imports(spark, sf_dir):
    return code.resolved_imports(generated(spark, sf_dir))


@query()
def code_symbols(spark, sf_dir):
    return code.symbols(generated(spark, sf_dir))


@query()
def code_config_keys(spark, sf_dir):
    return code.config_keys(generated(spark, sf_dir))


@query()
def code_tested_files(spark, sf_dir):
    return code.tested_files(generated(spark, sf_dir))


@query()
def code_graph_edges(spark, sf_dir):
    return code.file_graph(generated(spark, sf_dir), "generated")[1]


@query(f"""WITH d AS (SELECT doc_id, {SQL_PATH} AS path, string_split(text, ' ')[1] AS title FROM documents), l AS (SELECT *, regexp_extract(path, '\\.([^./]+)$', 1) AS ext FROM d)
SELECT doc_id, concat_ws('. ', 'From file: ' || path, CASE WHEN title <> '' THEN 'Defines: ' || title END, 'Purpose: Say what ' || doc_id || ' is for', 'Language: ' || CASE ext WHEN 'go' THEN 'go' WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python' ELSE 'text' END) || '.' AS context FROM l""")
def enriched_context(spark, sf_dir):
    """The sentences of context that go before a chunk, its first comment included."""
    said = F.concat(F.lit("// Say what "), F.col("doc_id").cast("string"), F.lit(" is for.\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", engine.context_of(path_of(), F.split("text", " ")[0], said).alias("context"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS b FROM conversations),
n AS (SELECT conv_id, max(b) AS total FROM c GROUP BY 1), i AS (SELECT conv_id, unnest(generate_series(0, total // 500)) AS item FROM n),
o AS (SELECT i.conv_id, item, turn, least(b, item * 500 + 500) - greatest(a, item * 500) AS overlap FROM i JOIN c ON i.conv_id = c.conv_id AND a < item * 500 + 500 AND b > item * 500)
SELECT conv_id, item, turn, overlap FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, item ORDER BY overlap DESC, turn) AS n FROM o) WHERE n = 1""")
def line_overlap_best(spark, sf_dir):
    """The turn that overlaps each 500-character window most: turns are dealt to the windows they touch, so the range join is an equality."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.sum(n).over(w) - n).alias("a"), F.sum(n).over(w).alias("b")).filter("b > a")
    o = c.withColumn("item", F.explode(F.sequence(F.floor(F.col("a") / 500), F.floor((F.col("b") - 1) / 500))))
    o = o.withColumn("overlap", F.least("b", F.col("item") * 500 + 500) - F.greatest("a", F.col("item") * 500))
    best = o.groupBy("conv_id", "item").agg(F.max(F.struct("overlap", (-F.col("turn")).alias("t"))).alias("m"))
    return best.select("conv_id", "item", (-F.col("m.t")).alias("turn"), F.col("m.overlap").alias("overlap"))


@query("""WITH b AS (SELECT source, substr(sha256(text), 1, 3) AS p, sha256(string_agg(sha256(text), ',' ORDER BY sha256(text))) AS v FROM documents GROUP BY 1, 2)
SELECT source, sha256(string_agg(v, ',' ORDER BY p)) AS version FROM b GROUP BY 1""")
def source_version(spark, sf_dir):
    """Digest of a source's file digests, in two levels: by 4,096 prefixes, then over these; a group holds a 4,096th of a source's digests."""
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    part = d.groupBy("source", F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"])
    return part.groupBy("source").agg(F.sha2(F.array_join(ordered, ","), 256).alias("version"))


@query("""WITH m AS (SELECT event_type, max(ts) AS last, count(*) AS n FROM events GROUP BY 1), x AS (SELECT max(last) AS now FROM m)
SELECT event_type, n, CASE WHEN now - last <= INTERVAL '1 hour' THEN 'fresh' WHEN now - last <= INTERVAL '24 hours' THEN 'recent' ELSE 'stale' END AS status FROM m, x""")
def status_snapshot(spark, sf_dir):
    """The latest build of each kind and how fresh it is."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max(F.col("ts").cast("timestamp")).alias("last"), F.count("*").alias("n"))
    age = F.unix_micros(F.max("last").over(Window.partitionBy())) - F.unix_micros("last")  # one row a kind
    return m.select("event_type", "n", F.when(age <= 3_600_000_000, "fresh").when(age <= 86_400_000_000, "recent").otherwise("stale").alias("status"))


@query(f"WITH {SQL_BM25} SELECT query, id, round(1 - 0.01 * (rank - 1), 4)::DOUBLE AS score, rank FROM kw WHERE rank <= 10")
def rerank_keep_order(spark, sf_dir):
    """The reranker of last resort: order kept, scores one hundredth apart."""
    return keyword(spark, sf_dir, 10).select("query", "id", F.round(1 - 0.01 * (F.col("rank") - 1), 4).cast("double").alias("score"), "rank")


@query(f"""WITH {SQL_BM25}, g AS (SELECT query, count(*) AS found, max(score) AS best FROM kw GROUP BY 1) SELECT item_id AS query, coalesce(found, 0) AS found, coalesce(found, 0) = 0 AS passes_negative,
 CASE WHEN found IS NULL THEN 'no_results' WHEN found < 5 THEN 'few_results' ELSE 'ok' END AS label FROM benchmark LEFT JOIN g ON item_id = query""")
def negative_case_labels(spark, sf_dir):
    g = keyword(spark, sf_dir).groupBy("query").agg(F.count("*").alias("found"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query")).join(g, "query", "left")
    found = F.coalesce("found", F.lit(0))
    return b.select("query", found.alias("found"), (found == 0).alias("passes_negative"), F.when(found == 0, "no_results").when(found < 5, "few_results").otherwise("ok").alias("label"))


@query("""WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, line, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
SELECT doc_id, count(*) AS lines, count(DISTINCT line) AS distinct_lines, max(length(line))::BIGINT AS longest FROM l GROUP BY 1""")
def line_statistics(spark, sf_dir):
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.array_distinct(lines)).cast("long").alias("distinct_lines"), F.array_max(F.transform(lines, F.length)).cast("long").alias("longest")
    )
