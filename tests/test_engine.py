"""The engine on a synthetic code corpus, end to end."""

import pytest
from pyspark.sql import functions as F

from gleaner import engine
from gleaner.operators import code
from gleaner.sources import corpus as source


@pytest.fixture(scope="module")
def files(spark):
    return source.generate(spark, 60)


@pytest.fixture(scope="module")
def corpus(files, tmp_path_factory):
    return engine.build_index(files, f"file://{tmp_path_factory.mktemp('index')}")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query int, q string")


def test_index_is_complete(corpus, files):
    s = engine.index_status(corpus).first()
    assert s.files == files.count() and s.without_vector == 0 and s.stale_edges == 0 and s.edges > 0
    ends = corpus.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    assert ends.join(corpus.nodes, "id", "left_anti").count() == 0


def test_exact_path_and_symbol_come_first(spark, corpus):
    name = corpus.chunks.filter("kind = 'code' AND path LIKE 'app/%' AND title LIKE 'run_%'").orderBy("path").first()
    got = engine.search(corpus, ask(spark, name.title, "nothing_like_this_anywhere"), engine.Options(limit=3)).collect()
    first = [r for r in got if r.query == 0 and r["rank"] == 1]
    assert first[0].title == name.title and all(r["rank"] <= 3 for r in got)


def test_filters_confine_results(spark, corpus):
    q = ask(spark, "server port name", "package fmt")
    assert {r.path.split("/")[0] for r in engine.search(corpus, q, engine.Options(scopes=("configs",))).collect()} == {"configs"}
    assert {r.path.rsplit(".", 1)[1] for r in engine.search(corpus, q, engine.Options(globs=("**/*.go",), classify=True)).collect()} == {"go"}
    assert {r.path.split("/")[0] for r in engine.search(corpus, q, engine.Options(profile="project_memory", keyword_only=True)).collect()} <= {"docs"}
    with pytest.raises(ValueError):
        engine.search(corpus, q, engine.Options(profile="none such"))


def test_approximate_search_agrees_mostly(spark, corpus):
    q = ask(spark, "package fmt import", "server port name limit", "class pass return")
    exact = {(r.query, r.chunk_id) for r in engine.search(corpus, q).collect()}
    near = {(r.query, r.chunk_id) for r in engine.search(corpus, q, engine.Options(approximate=True)).collect()}
    assert len(exact & near) / len(exact) >= 0.8


def test_reranker_replaces_the_order(spark, corpus):
    o = engine.Options(limit=5, reranker=lambda q, c: F.length(c).cast("double"))
    got = engine.search(corpus, ask(spark, "package fmt"), o).orderBy("rank").collect()
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True) and got[0].score > 1


def test_context_and_graph(spark, corpus):
    hit = corpus.chunks.filter("path = 'internal/m0.go'").select("chunk_id")
    near = engine.expand_context(corpus, hit).collect()
    assert near and all(abs(r.gap) == 1 for r in near)
    rows = engine.graph_query(corpus, spark.createDataFrame([("internal/m0.go",)], "subject string")).collect()
    assert {"file_imports", "file_defines_symbol", "test_covers_implementation"} <= {r.kind for r in rows}


def test_an_index_that_grew_equals_one_built_anew(spark, corpus, files, tmp_path):
    """Files changed, removed and added: rows, scores, stale edges; then reconciliation."""
    files = files.filter(F.col("path").rlike("[a-z][0-2][._]"))
    start = engine.build_index(files, f"file://{tmp_path}/grown")
    changed = spark.createDataFrame([("docs/n0.md", "# New\n\nSee `internal/m1.go` anew."), ("app/extra.py", "def extra():\n    return 1\n")], "path string, content string")
    removed = spark.createDataFrame([("internal/m2.go",)], "path string")
    now = engine.update_index(start, changed, removed)
    assert engine.Corpus.read(spark, now.path).segment == 1 and now.state["project"] == "project"
    gone = changed.select("path").union(removed)
    final = files.join(gone, "path", "left_anti").unionByName(changed)
    fresh = engine.build_index(final, f"file://{tmp_path}/fresh")
    rows = lambda df: sorted(map(str, df.collect()))
    for name in ("files", "chunks", "vectors", "nodes"):
        columns = sorted(fresh.table(name).columns)
        assert rows(now.table(name).select(columns)) == rows(fresh.table(name).select(columns)), name
    live = now.edges.filter("NOT stale").select("id", "kind", "confidence")
    assert rows(live) == rows(fresh.edges.select("id", "kind", "confidence"))
    assert now.edges.filter("stale").count() > 0 and start.edges.filter("stale").count() == 0
    info = engine.index_information(now).first()
    assert info.compatible and info.orphans > 0 and not engine.index_information(now, "other", 512).first().compatible
    same, found = engine.reconcile(now, files)
    assert {r.change: r.n for r in found.collect()} == {"modified": 1, "removed": 1, "added": 1}
    assert rows(same.files.select("path", "content")) == rows(files.select("path", "content")) and same.edges.filter("stale").count() == 0


def test_repair(spark, files, tmp_path):
    c = engine.build_index(files.filter(F.col('path').rlike('[a-z][0-1][._]')), f"file://{tmp_path}/broken")
    some = c.vectors.limit(3)
    engine.segments.put(f"{c.path}/vectors", 1, some.select(F.concat(F.lit("x"), "chunk_id").alias("chunk_id"), "embedding"), some.select("chunk_id"))
    for name in ("files", "chunks"):
        engine.segments.put(f"{c.path}/{name}", 1, c.table(name).limit(0), c.table(name).select(engine.KEYS[name]).limit(0))
    engine.graph_index.unchanged(engine.graph_index.GraphIndex(spark, c.path, 0))
    engine.bm25.change(spark, c.terms, 1, some.select(F.col("chunk_id").alias("id")), c.chunks.limit(0), "chunk_id", "content")
    engine._note(spark, c.path, 1, {"project": "project"})
    broken = engine.Corpus.read(spark, c.path)
    assert {r.problem: r["count"] for r in engine.problems(broken).groupBy("problem").count().collect()} == {"no_vector": 3, "no_postings": 3, "orphan_vector": 3}
    whole = engine.repair(broken)
    assert engine.problems(whole).count() == 0
    small = engine.compact(whole, f"file://{tmp_path}/small")
    assert small.segment == 0 and engine.problems(small).count() == 0 and engine.index_information(small).first().orphans == 0


def test_candidates_and_sub_queries(spark, corpus):
    name = corpus.chunks.filter("kind = 'code' AND path LIKE 'app/%' AND title LIKE 'run_%'").orderBy("path").first()
    got = engine.search(corpus, ask(spark, name.title), engine.Options(limit=3, add_candidates=True)).orderBy("rank").first()
    assert got.title == name.title
    many = engine.search_decomposed(corpus, ask(spark, "how does ledger work", "plain words here"), engine.Options(limit=5)).collect()
    assert {r.query for r in many} == {0, 1} and all(r["rank"] <= 5 for r in many) and max(r.hits for r in many if r.query == 0) >= 1
    with pytest.raises(ValueError):
        engine.search(corpus, ask(spark, "x"), engine.Options(decisions="all"))
    assert engine.clamp(None, 10, 1, 50) == 10 and engine.clamp(99, 10, 1, 50) == 50 and engine.clamp(-3, 10, 1, 50) == 1


def test_notes_about_subjects(spark, corpus):
    rows = [("internal/m0.go", "path"), ("internal/m0.g", "path"), ("main.rs", "auto"), ("m1.go", "auto")]
    notes = {r.subject: r for r in engine.graph_notes(corpus, spark.createDataFrame(rows, "subject string, type string")).collect()}
    assert notes["internal/m0.go"].state == "resolved" and notes["internal/m0.g"].state == "not_found" and "m0.go" in notes["internal/m0.g"].hints
    assert notes["main.rs"].warning == "rust" and notes["m1.go"].state == "resolved" and notes["m1.go"].warning is None


def test_relations_of_files(spark):
    rows = [
        ("a/x.go", 'package a\nimport (\n\t"fmt"\n\t"app/b/y"\n)\nfunc (s *S) Do() {}\nfunc Run() {}\n'), ("b/y.go", "package b\n"), ("a/x_test.go", "package a\n"), ("src/u.ts", "import { v } from './v';\nexport function f() {}\n"),
        ("src/v.ts", "export class V {}\n"), ("p/m.py", "from p.n import z\nimport os\nclass K:\n    pass\n"), ("p/n.py", "z = 1\n"), ("d.md", "see `b/y.go` and [t](a/x.go)\n"), ("c.yaml", "a:\n  b: 1\nd: 2\n"), ("e.env", "KEY=1\n"), ("t.toml", "top = 1\n[tool.x]\nk = 2\n"), ('j.json', '{"p": {"q": {"r": 1}}, "s": [1]}'),
    ]
    f = spark.createDataFrame(rows, "path string, content string")
    assert {(r.path, r.file) for r in code.resolved_imports(f).collect()} == {("a/x.go", "b/y.go"), ("src/u.ts", "src/v.ts"), ("p/m.py", "p/n.py")}
    assert {(r.name, r.kind, r.line) for r in code.symbols(f).collect()} == {("Do", "method", 6), ("Run", "function", 7), ("f", "function", 2), ("V", "class", 1), ("K", "class", 3)}
    assert {(r.path, r.key) for r in code.config_keys(f).collect()} == {("c.yaml", "a"), ("c.yaml", "a.b"), ("c.yaml", "d"), ("e.env", "KEY"), ("t.toml", "top"), ("t.toml", "tool.x"), ("t.toml", "tool.x.k"), ("j.json", "p"), ("j.json", "p.q"), ("j.json", "p.q.r"), ("j.json", "s")}
    assert {(r.test, r.file, r.confidence) for r in code.tested_files(f).collect()} == {("a/x_test.go", "a/x.go", 0.72)}
    assert {(r.target, r.confidence) for r in code.mentions(f, f.select(F.col("path").alias("target"))).collect()} == {("b/y.go", 0.72), ("a/x.go", 0.9)}
