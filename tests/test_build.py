"""Builds that go on, vectors that are kept, logs of runs, and searches that use expansion and policies."""

import pytest
from pyspark.sql import functions as F

from gleaner import build_log, engine
from gleaner.operators import embedding_cache, expansion, vectors
from gleaner.sources import corpus as source


@pytest.fixture(scope="module")
def files(spark):
    return source.generate(spark, 20)


def test_a_build_goes_on_where_it_stopped(spark, files, tmp_path, monkeypatch):
    place, broken, calls = f"file://{tmp_path}/index", engine.bm25.build, []
    real = engine.chunked
    monkeypatch.setattr(engine, "chunked", lambda f: calls.append("chunked") or real(f))

    def stop(*_, **__):
        raise RuntimeError("stopped")

    monkeypatch.setattr(engine.bm25, "build", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        engine.build_index(files, place)
    monkeypatch.setattr(engine.bm25, "build", broken)
    made = engine.build_index(files, place)
    assert calls == ["chunked"] and engine.problems(made).count() == 0
    log = {r.stage: r for r in build_log.summary(spark, place).collect()}
    assert log["chunks"].note == "done before" and log["terms"].note is None and log["edges of file_imports"].rows > 0
    assert {r.warning for r in engine.warnings(made).collect()} <= {"file_without_chunk"}
    again = engine.build_index(files.limit(5), place)  # a finished build is followed by a new one
    assert calls == ["chunked", "chunked"] and again.files.count() == 5
    later = engine.update_index(again, files.filter("path LIKE 'docs/%'"), files.limit(1).select("path"))
    logged = build_log.runs(spark, place).filter("segment = 1 AND stage = 'files'").first()
    assert later.segment == 1 and logged.rows == files.filter("path LIKE 'docs/%'").count()


def test_only_new_contents_are_embedded(spark, tmp_path):
    asked = []

    def embed(c):
        asked.append(c.count())
        return vectors.static_embedding(c, "id", "content", 8)

    cache, p = embedding_cache.Cache(spark, f"file://{tmp_path}/cache"), embedding_cache.Provider("small", embed)
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "content string")
    first, model = cache.embedded(texts("a b", "c d", "a b"), [p])
    assert model == "small" and first.count() == 2
    second, _ = cache.embedded(texts("c d", "e f", ""), [p])
    assert second.count() == 3 and asked == [2, 2]
    both = {r.key: r.embedding for r in first.collect()}
    assert all(both.get(r.key, r.embedding) == r.embedding for r in second.collect())

    def fails(_):
        raise ValueError("no model here")

    third, model = cache.embedded(texts("a b"), [embedding_cache.Provider("away", fails), p])
    assert model == "small" and third.count() == 1 and asked == [2, 2, 0]
    assert cache.sweep("small", since=2) == 0 and cache.sweep("small", since=3) == 3
    assert cache.embedded(texts("a b", "c d"), [p])[0].count() == 2 and asked[-1] == 1
    with pytest.raises(RuntimeError, match="no model here"):
        cache.embedded(texts("x"), [embedding_cache.Provider("away", fails)])


def test_search_with_expansion_policy_and_providers(spark, files, tmp_path):
    own = embedding_cache.Provider("own", lambda c: vectors.static_embedding(c, "id", "content", 16))
    made = engine.build_index(files, f"file://{tmp_path}/own", providers=(own,))
    assert made.state["model"] == "own" and made.state["dimensions"] == "16"
    q = spark.createDataFrame([(0, "which method does work"), (1, "run_0"), (2, "")], "query int, q string")
    said = {r["query"]: r.q for r in expansion.expanded(q, "query", "q").collect()}
    assert said == {0: "which method does work func fn def", 1: "run_0", 2: ""}
    o = engine.Options(limit=5)
    plain = engine.search(made, q, o).collect()  # no vectors of this model for queries: keywords decide
    both = engine.search(made, q, engine.Options(limit=50, provider=own)).collect()
    assert not any(r.in_both for r in plain) and any(r.in_both for r in both)
    kept = engine.search(made, q, engine.Options(limit=5, provider=own, rerank="auto", reranker=lambda q, c: F.lit(7.0))).collect()
    assert {r.score == 7.0 for r in kept if r.query == 0} == {True} and {r.score == 7.0 for r in kept if r.query == 1} == {False}
    with pytest.raises(ValueError, match="provider is needed"):
        engine.update_index(made, files.limit(1), files.limit(0).select("path"))
    with pytest.raises(ValueError):
        engine.search(made, q, engine.Options(rerank="sometimes"))
