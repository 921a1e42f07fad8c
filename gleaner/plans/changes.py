"""Indexes that follow changes, over files made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import graph_index
from gleaner.registry import query
from gleaner.session import scratch, table

_REFERS = "(doc_id + n_chars % 97 + 1)"
#: The last state of `grown_graph` in SQL: files by document, what each refers to, and the first candidate that is there.
SQL_GROWN = f"""d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN {_REFERS} + 1 ELSE {_REFERS} END AS j FROM documents),
f AS (SELECT doc_id, j, 'src/d' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.go' WHEN 1 THEN '.py' ELSE '.md' END AS path FROM d WHERE doc_id % 10 <> 9
 UNION ALL SELECT doc_id, j, 'src/d' || doc_id || '/__init__.py' FROM d WHERE doc_id % 4 = 1),
r AS (SELECT path, 'file_imports' AS kind, 'src/d' || j || e AS file FROM f, (SELECT unnest(['.go', '.py', '/__init__.py']) AS e) WHERE path NOT LIKE '%.md'
 UNION ALL SELECT path, 'doc_mentions_file', 'src/d' || j || '.go' FROM f WHERE path LIKE '%.md')"""


def _files(docs):
    """Two files (path, content) of some documents: whole texts under a line that refers to another document's file, which may not be there."""
    target = F.concat(F.lit("d"), F.col("j").cast("string"))
    own = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"))
    ending = F.when(F.col("doc_id") % 3 == 0, ".go").when(F.col("doc_id") % 3 == 1, ".py").otherwise(".md")
    head = F.when(F.col("e") == ".go", F.concat(F.lit('package d\nimport "app/src/'), target, F.lit('"\n'))).when(F.col("e") == ".md", F.concat(F.lit("See `src/"), target, F.lit(".go`.\n")))
    head = F.coalesce(head, F.concat(F.lit("import src."), target, F.lit("\n")))
    both = docs.withColumn("e", F.explode(F.array_compact(F.array(ending, F.when(F.col("doc_id") % 4 == 1, "/__init__.py")))))
    return both.select("doc_id", (F.col("doc_id") % 3).alias("third"), "e", F.concat(own, "e").alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))


@query(f"""WITH {SQL_GROWN} SELECT kind, path, min(r.file) AS other FROM r JOIN (SELECT path AS file FROM f) k USING (file) WHERE r.file <> path GROUP BY kind, path""")
def grown_graph(spark, sf_dir):
    """References between files after a build and three changes: a third of the documents first, then the others, some
    with new references, some gone; files that came later are found from files that didn't change."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") + F.col("n_chars") % 97 + 1).alias("j"))
    at = scratch(spark, "grown-files")
    _files(docs).write.partitionBy("third").parquet(at)
    part = lambda k: spark.read.parquet(at).filter(F.col("third") == k).select("path", "content")
    none = docs.select(F.lit("").alias("path")).limit(0)
    g = graph_index.build(scratch(spark, "grown-graph"), part(2))
    g = graph_index.change(g, part(0), none)
    g = graph_index.change(g, part(1), none)
    turned = _files(docs.filter(F.col("doc_id") % 6 == 0).withColumn("j", F.col("j") + 1)).select("path", "content")
    removed = _files(docs.filter(F.col("doc_id") % 10 == 9)).filter("e <> '/__init__.py'").select("path")
    g = graph_index.change(g, turned.join(removed, "path", "left_anti"), removed)
    name = g.table("nodes").filter("kind IN ('file', 'doc')").select("id", "path")
    links = g.links().filter("kind IN ('file_imports', 'doc_mentions_file')")
    src, dst = name.select(F.col("id").alias("src"), "path"), name.select(F.col("id").alias("dst"), F.col("path").alias("other"))
    return links.join(src, "src").join(dst, "dst").select("kind", "path", "other")
