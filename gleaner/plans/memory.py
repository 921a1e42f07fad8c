"""Records in texts, bounded memories, greedy choices and graded ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.text import NATURAL, query_class
from gleaner.operators import records
from gleaner.plans.search import SQL_BM25, keyword
from gleaner.plans.sources import streams
from gleaner.plans.texts import _LEX, _QSET, fixed_queries
from gleaner.registry import query
from gleaner.session import scratch, table

_RECORDS = """SELECT * FROM (VALUES (1, 'Status: Accepted' || chr(10) || 'Supersedes: ADR-1, adr-2'), (2, '- **Status**: Proposed'), (3, 'Status: Superseded by ADR-9'), (4, 'no status at all'), (5, 'Superseded-by: ADR-7' || chr(10) || 'status: accepted')) AS r(id, content)"""


@query(rf"""WITH r AS ({_RECORDS}), p AS (SELECT id, lower(regexp_extract(content, '(?im)^(?:[-*]\s*)?\**status\**\s*:\s*\**\s*([a-z]+)', 1)) AS raw, regexp_extract(content, '(?im)^supersedes\s*:\s*(.*)$', 1) AS sup,
 regexp_extract(content, '(?i)superseded[ -]by\s*:?\s*(ADR-\d+)', 1) AS sby FROM r)
SELECT id, CASE WHEN sby <> '' THEN 'superseded' WHEN raw IN ('proposed', 'accepted', 'implemented', 'deprecated', 'superseded', 'rejected') THEN raw ELSE 'unknown' END AS status,
 array_to_string(list_transform(regexp_extract_all(sup, '(?i)(ADR-\d+)', 1), lambda x: upper(x)), ',') AS supersedes, upper(sby) AS superseded_by FROM p""")
def decision_records(spark, sf_dir):
    r = spark.sql(_RECORDS.replace("(VALUES", "VALUES").replace("accepted'))", "accepted')")).select("id", records.decision(F.col("content")).alias("d"))
    return r.select("id", "d.status", F.array_join("d.supersedes", ",").alias("supersedes"), F.array_join("d.superseded_by", ",").alias("superseded_by"))


@query(f"SELECT id, {_LEX} = false AND (regexp_matches(trim(q), '{NATURAL}') OR len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda w: w <> '')) >= 3) AS apply FROM ({_QSET})")
def reranker_policy(spark, sf_dir):
    return fixed_queries(spark).select("id", records.reranker_policy(query_class(F.col("q"))["kind"])["apply"].alias("apply"))


@query()
def similar_query_rate(spark, sf_dir):
    """Vectors stand for query embeddings, their label for the user."""
    return records.similar_queries(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type || '|' || props ORDER BY ts, event_id) > 1 AS again FROM events) SELECT user_id AS "user", count(*) AS n, sum(CASE WHEN again THEN 1 ELSE 0 END)::BIGINT AS repeats FROM r GROUP BY 1""")
def stream_repeats(spark, sf_dir):
    """The repeat rate as a stateful stream; each user has fewer distinct queries than the memory holds here, so counts are exact."""
    out = scratch(spark, "repeats")
    e = streams.event_stream(spark, sf_dir).withColumn("q", F.concat_ws("|", "event_type", "props"))

    def sink(batch, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    streams.run_to_end(records.repeat_stream(e, "user_id", "q", "ts"), sink, scratch(spark, "repeats-state"), mode="update")
    return spark.read.parquet(out).groupBy("user").agg(F.max_by(F.struct("n", "repeats"), "batch").alias("v")).select("user", "v.n", "v.repeats")


@query()
def greedy_intervals(spark, sf_dir):
    """Turns as spans of their conversation: of overlapping ones the longest, greedily."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("start_line"), (F.col("turn") + F.pmod(F.length("text"), F.lit(4))).alias("end_line"))
    return records.greedy_intervals(c, ["conv_id", "role"])


@query(f"""WITH {SQL_BM25}, g AS (SELECT query, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS grade, rank FROM kw JOIN labels ON doc_id = id WHERE rank <= 10),
s AS (SELECT query, sum((power(2, grade) - 1) / log2(rank + 1)) AS dcg FROM g GROUP BY 1), i AS (SELECT query, (power(2, grade) - 1) / log2(row_number() OVER (PARTITION BY query ORDER BY grade DESC) + 1) AS x FROM g), b AS (SELECT query, sum(x) AS best FROM i GROUP BY 1)
SELECT query, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg FROM s JOIN b USING (query)""")
def ndcg(spark, sf_dir):
    """Graded ranking against the best order of the same judged results."""
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0)
    r = keyword(spark, sf_dir, 10).join(table(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id")).select("query", F.col("id").cast("string").alias("path"), "rank", grade.alias("grade"))
    return records.ndcg(r.select("query", "path", "rank"), r.select("query", "path", "grade"))
