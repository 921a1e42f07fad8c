"""Graph construction and traversal over the star schema: rows are nodes, foreign keys are edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.joins import bounded
from gleaner.functions.text import confidence_label
from gleaner.operators import graph, traversal
from gleaner.registry import query
from gleaner.session import scratch, table

_KINDS = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", None), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", None))
#: (table, kind, source kind, source column, target kind, target column, confidence, heuristic, stale) as SQL.
_EDGES = (
    ("nation", "contains", "region", "n_regionkey", "nation", "n_nationkey", "1.0", "false", "false"),
    ("customer", "lives_in", "customer", "c_custkey", "nation", "c_nationkey", "0.95", "false", "c_acctbal < 0"),
    ("supplier", "lives_in", "supplier", "s_suppkey", "nation", "s_nationkey", "0.95", "false", "s_acctbal < 0"),
    ("orders", "ordered_by", "orders", "o_orderkey", "customer", "o_custkey", "1.0", "false", "o_orderstatus = 'P'"),
    ("lineitem", "has_part", "orders", "l_orderkey", "part", "l_partkey", "CASE l_returnflag WHEN 'R' THEN 0.45 WHEN 'A' THEN 0.72 ELSE 0.9 END", "l_returnflag <> 'N'", "l_linestatus = 'F' AND l_discount > 0.08"),
    ("lineitem", "supplied_by", "part", "l_partkey", "supplier", "l_suppkey", "CASE l_returnflag WHEN 'R' THEN 0.45 WHEN 'A' THEN 0.72 ELSE 0.9 END", "l_returnflag <> 'N'", "l_linestatus = 'F' AND l_discount > 0.08"),
)
SQL_NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT 'node:{k}:shop:' || {c} AS id, '{k}' AS kind, {c}::VARCHAR AS key, {n or f'{chr(39)}{k} {chr(39)} || {c}'} AS name FROM {k}" for k, c, n in _KINDS) + ")"
SQL_EDGES = "edges AS (SELECT 'edge:' || substr(sha256('shop|cheap|' || source || '|' || kind || '|' || src || '|' || dst), 1, 24) AS id, * FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS source, '{k}' AS kind, 'node:{a}:shop:' || {ac} AS src, 'node:{b}:shop:' || {bc} AS dst, ({conf})::DOUBLE AS confidence, {h} AS heuristic, {st} AS stale FROM {t}" for t, k, a, ac, b, bc, conf, h, st in _EDGES
) + "))"


def nodes(spark, sf_dir):
    out = None
    for kind, col, name in _KINDS:
        key = F.col(col).cast("string")
        part = table(spark, sf_dir, kind).select(graph.node_id(kind, F.col(col)).alias("id"), F.lit(kind).alias("kind"), key.alias("key"), (F.col(name) if name else F.concat(F.lit(f"{kind} "), key)).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark, sf_dir):
    out = None
    for t, kind, a, ac, b, bc, conf, h, st in _EDGES:
        src, dst = graph.node_id(a, F.col(ac)), graph.node_id(b, F.col(bc))
        part = table(spark, sf_dir, t).select(
            graph.edge_id("cheap", F.lit(t), F.lit(kind), src, dst).alias("id"), F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"),
            F.expr(conf).cast("double").alias("confidence"), F.expr(h).alias("heuristic"), F.expr(st).alias("stale"),
        )
        out = part if out is None else out.unionByName(part)
    return out


#: Keys below this, either sign, fit into a node's number.
_HALF = 1 << 57
_NODES, _NAMED = [k for k, _, _ in _KINDS], sorted({e[1] for e in _EDGES})


def _fits(spark, sf_dir) -> bool:
    """Whether all keys of edges are whole numbers that fit."""
    keys = sorted({(t, c) for t, _, _, ac, _, bc, *_ in _EDGES for c in (ac, bc)} | {("customer", "c_custkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey")})
    for t in sorted({t for t, _ in keys}):
        rows = table(spark, sf_dir, t).select(*[c for x, c in keys if x == t])
        if any(kind not in ("tinyint", "smallint", "int", "bigint") for _, kind in rows.dtypes):
            return False
        ends = rows.agg(*[f(c) for c in rows.columns for f in (F.min, F.max)]).first()
        if any(abs(x) >= _HALF for x in ends if x is not None):
            return False
    return True


def numbered(spark, sf_dir):
    """(edges, node of a kind and key, its id): src, dst, kind and confidence of all edges with numbers for nodes and kinds, a quarter of
    the ids' bytes. Numbers of kinds are in the kinds' order, those of nodes aren't in the ids'; if a key doesn't fit, nodes are ids."""
    if _fits(spark, sf_dir):
        of = lambda kind, key: F.lit((_NODES.index(kind) << 58) + _HALF) + key.cast("bigint")
        name = lambda n: graph.node_id(F.element_at(F.array(*map(F.lit, _NODES)), F.shiftright(n, 58).cast("int") + 1), n.bitwiseAND(F.lit((1 << 58) - 1)) - F.lit(_HALF))
    else:
        of, name = graph.node_id, lambda n: n
    out = None
    for t, kind, a, ac, b, bc, conf, _, _ in _EDGES:
        part = table(spark, sf_dir, t).select(of(a, F.col(ac)).alias("src"), of(b, F.col(bc)).alias("dst"), F.lit(_NAMED.index(kind)).cast("tinyint").alias("kind"), F.expr(conf).cast("double").alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out, of, name


def regions(spark, sf_dir):
    return table(spark, sf_dir, "region").select(graph.node_id("region", F.col("r_regionkey")).alias("seed"))


@query(f"WITH {SQL_NODES} SELECT id, kind, key, name FROM nodes")
def graph_nodes(spark, sf_dir):
    return nodes(spark, sf_dir)


@query(f"WITH {SQL_EDGES} SELECT id, kind, src, dst, confidence FROM edges")
def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir).select("id", "kind", "src", "dst", "confidence")


_LABEL = "CASE WHEN confidence >= 1 THEN 'exact' WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END"


@query(f"WITH {SQL_EDGES} SELECT kind, {_LABEL} AS label, count(*) AS n, sum(CASE WHEN stale THEN 1 ELSE 0 END)::BIGINT AS stale, sum(CASE WHEN heuristic THEN 1 ELSE 0 END)::BIGINT AS heuristic FROM edges GROUP BY 1, 2")
def graph_snapshot_counts(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("kind", confidence_label(F.col("confidence")).alias("label")).agg(F.count("*").alias("n"), F.count_if("stale").alias("stale"), F.count_if("heuristic").alias("heuristic"))


@query(f"""WITH {SQL_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY confidence DESC, heuristic, id) AS n, count(*) OVER (PARTITION BY src, dst, kind) AS c FROM edges WHERE kind = 'supplied_by')
SELECT src, dst, kind, id, confidence, heuristic, c - 1 AS suppressed FROM r WHERE n = 1""")
def edge_merge(spark, sf_dir):
    return graph.best_edges(edges(spark, sf_dir).filter("kind = 'supplied_by'")).drop("stale")


@query(f"""WITH {SQL_EDGES}, s AS (SELECT 'node:nation:shop:' || n_nationkey AS seed FROM nation)
SELECT seed, dst AS other, kind, CASE kind WHEN 'contains' THEN 'child' WHEN 'lives_in' THEN 'home' END AS role, 'out' AS direction, confidence FROM edges JOIN s ON src = seed
UNION ALL SELECT seed, src, kind, CASE kind WHEN 'contains' THEN 'parent' WHEN 'lives_in' THEN 'resident' END, 'in', confidence FROM edges JOIN s ON dst = seed""")
def related_single_hop(spark, sf_dir):
    seeds = table(spark, sf_dir, "nation").select(graph.node_id("nation", F.col("n_nationkey")).alias("seed"))
    return graph.related(edges(spark, sf_dir), bounded(seeds))


@query(f"""WITH {SQL_EDGES}, s AS (SELECT 'node:orders:shop:' || o_orderkey AS seed FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT seed, kind, count(DISTINCT dst) AS targets, round(max(confidence), 6) AS best FROM edges JOIN s ON src = seed GROUP BY 1, 2""")
def impact_outgoing(spark, sf_dir):
    seeds = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(graph.node_id("orders", F.col("o_orderkey")).alias("seed"))
    hit = graph.related(edges(spark, sf_dir), seeds, ("out",))
    return hit.groupBy("seed", "kind").agg(F.count_distinct("other").alias("targets"), F.round(F.max("confidence"), 6).alias("best"))


@query(f"""WITH {SQL_EDGES}, r AS (SELECT dst AS seed, kind, src AS other, row_number() OVER (PARTITION BY dst, kind ORDER BY confidence DESC, src, id) AS rank FROM edges WHERE kind IN ('lives_in', 'ordered_by'))
SELECT seed, kind, other, rank FROM r WHERE rank <= 3""")
def per_kind_cap(spark, sf_dir):
    e = edges(spark, sf_dir).filter(F.col("kind").isin("lives_in", "ordered_by")).select(F.col("dst").alias("seed"), "kind", F.col("src").alias("other"), "confidence", "id")
    return graph.capped(e, 3, ["seed", "kind"], F.col("confidence").desc(), F.col("other"), F.col("id")).select("seed", "kind", "other", "rank")


@query(f"""WITH {SQL_EDGES}, r AS (SELECT dst AS seed, src, sum(octet_length(encode(src)) + 1) OVER w AS bytes, row_number() OVER w AS rank FROM edges WHERE kind = 'lives_in' WINDOW w AS (PARTITION BY dst ORDER BY src ROWS UNBOUNDED PRECEDING))
SELECT seed, src, bytes::BIGINT AS bytes, rank FROM r WHERE bytes <= 400 OR rank = 1""")
def byte_budget(spark, sf_dir):
    e = edges(spark, sf_dir).filter("kind = 'lives_in'").select(F.col("dst").alias("seed"), "src")
    return graph.within_budget(e, 400, "seed", F.col("src"), F.col("src"))


_SUBJECTS = ("GERMANY", "germany", "node:region:shop:1", "ASIA", "AMERIC", "nothing like it", "NATION_3", "REGION_1", "asi")


def subjects(spark, listed=_SUBJECTS):
    return spark.createDataFrame([(s,) for s in listed], "subject string")


_ALL_SUBJECTS = (*_SUBJECTS, "Customer#000000001", "customer#00000002", "supplier 3", "SUPPLIER 1", "node:part:shop:7", "orders 7", "order 1")
_ALL_SUBJECT_SQL = "subjects AS (SELECT unnest([" + ", ".join(f"'{s}'" for s in _ALL_SUBJECTS) + "]) AS subject)"


@query(f"""WITH {SQL_NODES}, {_ALL_SUBJECT_SQL}, h AS (SELECT subject, id, CASE WHEN key = subject THEN 0 WHEN name = subject THEN 2 WHEN id = subject THEN 3 WHEN lower(key) = lower(subject) THEN 4 WHEN lower(name) = lower(subject) THEN 6
 WHEN lower(id) = lower(subject) THEN 7 WHEN contains(lower(name), lower(subject)) THEN 10 WHEN contains(lower(id), lower(subject)) THEN 11 END AS score FROM nodes, subjects),
b AS (SELECT *, min(score) OVER (PARTITION BY subject) AS best FROM h WHERE score IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY id) AS rn, count(*) OVER (PARTITION BY subject) AS n FROM b WHERE score = best)
SELECT subject, id, score, CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM t WHERE rn <= 10""")
def subject_resolution(spark, sf_dir):
    """Subjects over every node of the graph."""
    return graph.resolve(nodes(spark, sf_dir), subjects(spark, _ALL_SUBJECTS))


@query(f"""WITH {SQL_NODES}, {_ALL_SUBJECT_SQL}, e AS (SELECT DISTINCT subject, name, levenshtein(lower(name), lower(subject)) AS edits FROM nodes, subjects),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY edits, name) AS rank FROM e WHERE edits <= 3) SELECT subject, name, edits::INTEGER AS edits, rank FROM r WHERE rank <= 5""")
def did_you_mean(spark, sf_dir):
    """Near names over every node of the graph."""
    return graph.nearest_names(nodes(spark, sf_dir), subjects(spark, _ALL_SUBJECTS))


@query(f"""WITH RECURSIVE {SQL_EDGES}, near AS (SELECT src, dst FROM edges WHERE source IN ('nation', 'customer', 'supplier')), u AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near),
walk(node, depth) AS (SELECT 'node:region:shop:1', 0 UNION SELECT dst, depth + 1 FROM walk JOIN u ON src = node WHERE depth < 3) SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY 1""")
def neighbors_bfs(spark, sf_dir):
    e = edges(spark, sf_dir).filter(F.col("kind").isin("contains", "lives_in"))
    return graph.neighbours(e, regions(spark, sf_dir).filter("seed = 'node:region:shop:1'"), 3)


@query(f"""WITH {SQL_EDGES}, e AS (SELECT DISTINCT src, dst, kind, confidence FROM edges WHERE source IN ('nation', 'orders', 'customer')), o AS (SELECT 'node:orders:shop:' || o_orderkey AS seed FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
p1 AS (SELECT src || '>' || dst AS path, kind AS kinds, confidence AS weakest, dst AS tip FROM e JOIN o ON src = seed), p2 AS (SELECT path || '>' || dst AS path, kinds || ',' || kind AS kinds, least(weakest, confidence) AS weakest, dst AS tip FROM p1 JOIN e ON src = tip)
SELECT path, kinds, weakest FROM p1 UNION ALL SELECT path, kinds, weakest FROM p2""")
def simple_paths(spark, sf_dir):
    seeds = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(graph.node_id("orders", F.col("o_orderkey")).alias("seed"))
    e = edges(spark, sf_dir).filter(F.col("kind").isin("contains", "lives_in", "ordered_by") & ~F.col("src").startswith("node:supplier"))
    return graph.paths(e, seeds, 2).select(F.array_join("path", ">").alias("path"), F.array_join("kinds", ",").alias("kinds"), "weakest")


@query(f"""WITH {SQL_EDGES}, one AS (SELECT src AS seed, dst AS node, confidence AS c, 1 AS hop FROM edges WHERE source = 'orders'), two AS (SELECT seed, dst AS node, least(c, confidence) AS c, 2 AS hop FROM one JOIN edges ON src = node WHERE source = 'customer'),
b AS (SELECT seed, node, max(c) AS c, min(hop) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, c DESC, node) AS rank FROM b) SELECT seed, node, c AS confidence, hop, rank FROM r WHERE rank <= 5""")
def context_pack(spark, sf_dir):
    """Up to five context nodes of each order: one and two hops, near and confident first."""
    e = edges(spark, sf_dir)
    one = e.filter("kind = 'ordered_by'").select(F.col("src").alias("seed"), F.col("dst").alias("node"), F.col("confidence").alias("c"), F.lit(1).alias("hop"))
    home = e.filter(F.col("src").startswith("node:customer") & (F.col("kind") == "lives_in"))
    two = one.join(home, one["node"] == home["src"]).select("seed", F.col("dst").alias("node"), F.least("c", "confidence").alias("c"), F.lit(2).alias("hop"))
    both = one.unionByName(two).groupBy("seed", "node").agg(F.max("c").alias("confidence"), F.min("hop").alias("hop"))
    return graph.capped(both, 5, ["seed"], F.col("hop"), F.col("confidence").desc(), F.col("node"))


@query(f"""WITH {SQL_EDGES}, gone AS (SELECT 'node:part:shop:' || p_partkey AS id FROM part WHERE p_size = 1) SELECT kind, count(*) AS n, sum(CASE WHEN stale OR dst IN (SELECT id FROM gone) THEN 1 ELSE 0 END)::BIGINT AS stale FROM edges GROUP BY 1""")
def stale_mark(spark, sf_dir):
    """Edges into removed nodes become stale."""
    gone = table(spark, sf_dir, "part").filter("p_size = 1").select(graph.node_id("part", F.col("p_partkey")).alias("dst"), F.lit(True).alias("gone"))
    e = edges(spark, sf_dir).join(gone, "dst", "left")
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("stale") | F.coalesce("gone", F.lit(False))).alias("stale"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_linestatus = 'F' AND l_discount > 0.08 AND l_shipdate < TIMESTAMP '1997-01-01')")
def purge_stale(spark, sf_dir):
    """Edges that stay when stale ones from before a cutoff go: one pushed-down predicate."""
    gone = (F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp"))
    return table(spark, sf_dir, "lineitem").filter(~gone).select("l_orderkey", "l_linenumber")


@query(f"WITH {SQL_EDGES}, {SQL_NODES} SELECT kind, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes) GROUP BY 1")
def edge_integrity(spark, sf_dir):
    """Edges that lack an endpoint: two anti joins."""
    e, n = edges(spark, sf_dir), nodes(spark, sf_dir).select("id")
    lost = e.join(n.withColumnRenamed("id", "src"), "src", "left_anti").select("id", "kind").unionByName(e.join(n.withColumnRenamed("id", "dst"), "dst", "left_anti").select("id", "kind"))
    return lost.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT p_name || '/' || p_size AS name, min(p_partkey) AS key FROM part GROUP BY 1 HAVING count(*) = 1")
def unique_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("name")).agg(F.min("p_partkey").alias("key"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#?]*)"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM l GROUP BY 1, 2""")
def link_edges(spark, sf_dir):
    """Edges from pages to the paths that they link to."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)"'), F.lit(1))).alias("target"))
    return p.groupBy("page_id", "target").agg(F.count("*").alias("n"))


_STEP = """h{d} AS (SELECT seed, node, max(confidence) AS confidence FROM (SELECT f.seed, u.dst AS node, least(f.confidence, u.confidence) AS confidence FROM k{p} f JOIN u ON u.src = f.node)
  WHERE (seed, node) NOT IN (SELECT (seed, node) FROM s{p}) GROUP BY seed, node),
r{d} AS (SELECT h.seed, node, confidence, row_number() OVER (PARTITION BY h.seed ORDER BY confidence DESC, node) AS pos, b.room FROM h{d} h JOIN l{p} b USING (seed)),
k{d} AS (SELECT seed, node, confidence FROM r{d} WHERE pos <= room), s{d} AS (SELECT * FROM s{p} UNION ALL SELECT seed, node FROM r{d} WHERE pos <= room + 1),
c{d} AS (SELECT seed FROM c{p} UNION SELECT seed FROM r{d} WHERE pos > room),
l{d} AS (SELECT b.seed, b.room - coalesce(k.n, 0) AS room FROM l{p} b LEFT JOIN (SELECT seed, count(*) AS n FROM k{d} GROUP BY seed) k USING (seed) WHERE b.seed NOT IN (SELECT seed FROM c{d}))"""


@query(f"""WITH {SQL_EDGES}, u AS (SELECT src, dst, max(confidence) AS confidence FROM (SELECT src, dst, confidence FROM edges UNION ALL SELECT dst, src, confidence FROM edges) GROUP BY src, dst),
k0 AS (SELECT 'node:supplier:shop:' || s_suppkey AS seed, 'node:supplier:shop:' || s_suppkey AS node, 1.0::DOUBLE AS confidence FROM supplier), s0 AS (SELECT seed, node FROM k0), c0 AS (SELECT seed FROM k0 WHERE false), l0 AS (SELECT seed, 40 AS room FROM k0),
{", ".join(_STEP.format(d=d, p=d - 1) for d in (1, 2, 3))}
SELECT seed, node, depth, confidence, seed IN (SELECT seed FROM c3) AS truncated FROM ({" UNION ALL ".join(f"SELECT seed, node, {d} AS depth, confidence FROM k{d}" for d in (1, 2, 3))})""")
def neighbours_bounded(spark, sf_dir):
    """Up to 40 nodes around each supplier within three hops over all edges, the surest of each hop first."""
    linked, node, name = numbered(spark, sf_dir)
    seeds = table(spark, sf_dir, "supplier").select(node("supplier", F.col("s_suppkey")).alias("seed"))
    found = traversal.neighbours(linked, seeds, 3, 40, scratch(spark, "neighbours"), name)
    return found.select(name(F.col("seed")).alias("seed"), name(F.col("node")).alias("node"), "depth", "confidence", "truncated")


@query(f"""WITH {SQL_EDGES}, e AS (SELECT src, dst, kind, max(confidence) AS confidence FROM edges GROUP BY src, dst, kind),
pairs AS (SELECT 'node:orders:shop:' || o_orderkey AS seed, 'node:nation:shop:' || c_nationkey AS target FROM orders JOIN customer ON o_custkey = c_custkey),
p1 AS (SELECT p.seed, [p.seed, e.dst] AS path, [e.kind] AS kinds, e.confidence AS weakest FROM (SELECT DISTINCT seed FROM pairs) p JOIN e ON e.src = p.seed),
p2 AS (SELECT seed, list_append(path, e.dst) AS path, list_append(kinds, e.kind) AS kinds, least(weakest, e.confidence) AS weakest FROM p1 JOIN e ON e.src = path[-1] WHERE NOT list_contains(path, e.dst)),
p3 AS (SELECT seed, list_append(path, e.dst) AS path, list_append(kinds, e.kind) AS kinds, least(weakest, e.confidence) AS weakest FROM p2 JOIN e ON e.src = path[-1] WHERE NOT list_contains(path, e.dst)),
d AS (SELECT q.seed, q.target, path, kinds, weakest, row_number() OVER (PARTITION BY q.seed, q.target ORDER BY len(kinds), weakest DESC, path, kinds) AS pos, count(*) OVER (PARTITION BY q.seed, q.target) AS n
 FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) a JOIN pairs q ON q.seed = a.seed AND q.target = path[-1])
SELECT seed, target, array_to_string(path, '>') AS path, array_to_string(kinds, ',') AS kinds, weakest, n > 3 AS truncated FROM d WHERE pos <= 3""")
def paths_bounded(spark, sf_dir):
    """The three best paths of up to three hops from every order to its customer's nation, over all edges: by the customer, or by a part's supplier there."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    linked, node, name = numbered(spark, sf_dir)
    ends = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(node("orders", F.col("o_orderkey")).alias("seed"), node("nation", F.col("c_nationkey")).alias("target"))
    found = traversal.paths(linked, ends, 3, 3, scratch(spark, "paths"), beam=10_000, name=name)
    kinds = F.transform("kinds", lambda k: F.element_at(F.array(*map(F.lit, _NAMED)), k.cast("int") + 1))
    return found.select(name(F.col("seed")).alias("seed"), name(F.col("target")).alias("target"), F.array_join(F.transform("path", name), ">").alias("path"), F.array_join(kinds, ",").alias("kinds"), "weakest", "truncated")
