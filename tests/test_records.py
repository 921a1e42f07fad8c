"""Records, memories and greedy choices on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import records as R


def test_front_matter_and_references(spark):
    text = "---\ntitle: \"A b\"\ntags: x\ntags: y\nempty:\n---\nSee `internal/a/b.go` and (docs/c.md), docs/c.md; not other/x.go."
    r = spark.createDataFrame([(text,), ("none",)], "t string").select(R.front_matter(F.col("t")).alias("m"), R.path_references(F.col("t")).alias("p")).collect()
    assert r[0].m == {"fm.title": "A b", "fm.tags": "y"} and r[0].p == ["internal/a/b.go", "docs/c.md"] and r[1].m is None and r[1].p == []


def test_submodules():
    assert R.submodules('[submodule "a"]\n\tpath = libs/a\n\turl = u\n# x\n[submodule "b"]\n url = v\n') == [{"name": "a", "path": "libs/a", "url": "u"}]


def test_cases_are_validated(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"tier1": [{"id": "q1", "query": "x", "expected": [{"path": "a", "grade": 3}]}], "negative": [{"id": "n1", "query": "y"}]}))
    assert [c["section"] for c in R.load_cases(str(f))] == ["tier1", "negative"]
    for bad in ({"tier1": [{"id": "q", "query": "x"}]}, {"negative": [{"id": "q", "query": "x"}] * 2}, {"tier1": [{"id": "q", "query": "x", "expected": [{"path": "a", "grade": 4}]}]}):
        f.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            R.load_cases(str(f))


def test_memory_forgets_the_least_recent():
    m = R.Memory(capacity=2)
    for h in "abacb":
        m.see(h)
    assert (m.n, m.repeats, list(m.hashes)) == (5, 1, ["c", "b"])


def test_similar_queries_use_a_ring(spark):
    rows = [(1, i, [1.0, 0.0] if i % 2 == 0 else [0.0, 1.0]) for i in range(6)] + [(2, 0, [1.0, 0.0])]
    q = spark.createDataFrame(rows, "u int, o int, v array<double>")
    assert {r.user: (r.n, r.similar) for r in R.similar_queries(q, "u", "o", "v").collect()} == {1: (6, 4), 2: (1, 0)}
    assert {r.user: r.similar for r in R.similar_queries(q, "u", "o", "v", recent=1).collect()} == {1: 0, 2: 0}


def test_greedy_intervals(spark):
    s = spark.createDataFrame([("f", 1, 10), ("f", 9, 30), ("f", 31, 33), ("f", 2, 3), ("g", 1, 2)], "k string, start_line int, end_line int")
    assert sorted(tuple(r) for r in R.greedy_intervals(s, ["k"]).collect()) == [("f", 2, 3), ("f", 9, 30), ("f", 31, 33), ("g", 1, 2)]


def test_ndcg_matches_one_to_one(spark):
    j = spark.createDataFrame([("q", "a", 3), ("q", "b/", 1), ("r", "x", 2)], "query string, path string, grade int")
    got = spark.createDataFrame([("q", "b/c", 1), ("q", "a", 2), ("q", "a", 3)], "query string, path string, rank int")
    out = {r.query: r.ndcg for r in R.ndcg(got, j).collect()}
    assert out["r"] == 0.0 and out["q"] == pytest.approx((1 + 7 / 1.584962500721156) / (7 + 1 / 1.584962500721156), abs=1e-6)
