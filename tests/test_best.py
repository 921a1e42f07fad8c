"""Searches that keep the best rows of each task give the rows of scoring every pair, and write no row a pair."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gleaner import catalog
from gleaner.functions.best import rounded
from gleaner.operators import bm25, vectors

WORDS = [f"w{i:02d}" for i in range(30)]


def texts(spark):
    rng = np.random.default_rng(5)
    rows = [(f"d{i % 190:03d}", " ".join(rng.choice(WORDS, 1 + i % 40))) for i in range(200)] + [(None, "w01 w02"), ("e", ""), ("x1", "w03 w04 w05"), ("x0", "w03 w04 w05")]
    return spark.createDataFrame(rows, "id string, text string")


@pytest.mark.parametrize("mode", ["and_then_or", "or"])
def test_best_of_tasks_are_the_best_of_all_pairs(spark, tmp_path, mode):
    docs, path = texts(spark), f"file://{tmp_path}/i"
    bm25.build(docs, "id", "text", path, 4)
    asked = spark.createDataFrame([(1, "w01 w02"), (2, "w03 w04 w05"), (3, "w06 none"), (4, "nothing here"), (5, " ".join(WORDS)), (2, "w07")], "query long, q string")
    bm25.change(spark, path, 1, docs.filter("id = 'd007'").select("id"), docs.limit(0), "id", "text")
    for k in (1, 7):
        mine = bm25.best_built(spark, path, asked, "query", "q", k, mode, 1)
        plain = bm25.best(bm25.scores_built(spark, path, asked, "query", "q", 1), k, mode)
        assert sorted(map(str, mine.collect())) == sorted(map(str, plain.collect()))
        assert "count(1)" not in mine._jdf.queryExecution().executedPlan().toString()


def test_many_queries_are_scored_pair_by_pair(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    bm25.build(texts(spark), "id", "text", path, 4)
    asked = spark.createDataFrame([(1, "w01 w02"), (2, "w03")], "query long, q string")
    mine = sorted(map(str, bm25.best_built(spark, path, asked, "query", "q", 3).collect()))
    monkeypatch.setattr(bm25, "QUERY_TERMS", 1)
    assert mine == sorted(map(str, bm25.best_built(spark, path, asked, "query", "q", 3).collect()))


def test_a_task_sorts_a_bounded_number_of_postings(spark, tmp_path, monkeypatch):
    """A larger index is dealt out to more tasks than are configured, and gives the same rows."""
    path = f"file://{tmp_path}/i"
    bm25.build(texts(spark), "id", "text", path, 4)
    asked = spark.createDataFrame([(1, " ".join(WORDS)), (2, "w03 w04")], "query long, q string")
    plain = sorted(map(str, bm25.best_built(spark, path, asked, "query", "q", 7).collect()))
    monkeypatch.setattr(bm25, "SORTED", 100)
    mine = bm25.best_built(spark, path, asked, "query", "q", 7)
    n = spark.read.parquet(f"{path}/postings/rows").count()
    assert f", {-(-n // 100)}), REPARTITION_BY_NUM" in mine._jdf.queryExecution().executedPlan().toString()
    assert plain == sorted(map(str, mine.collect()))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_of_tasks_are_the_nearest_of_all_pairs(spark, metric, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4 + i % 2).round(1).tolist()) for i in range(120)] + [(200, None), (201, [0.0] * 4), (202, [float("nan"), 1.0, 0.0, 0.0]), (203, [None, 1.0, 2.0, 3.0]), (204, []), (205, rows_like := [1.0, 0.0, 0.0, 0.0]), (206, rows_like)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.filter("vec_id < 9 or vec_id = 205")
    mine = vectors.nearest(v, asked, 5, metric)
    assert "NestedLoopJoin BuildRight, Inner, (size(v" not in mine._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = sorted(map(str, mine.collect()))
    monkeypatch.setattr(vectors, "QUERIES", 1)
    assert got == sorted(map(str, vectors.nearest(v, asked, 5, metric).collect()))


def test_lists_give_the_best_of_those_read(spark):
    """All lists read: the rows of the exact search, whatever order lists and queries come in."""
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(150)], "vec_id long, embedding array<double>").repartition(5)
    q = v.filter("vec_id % 10 = 0")
    near = vectors.nearest_by_lists(v, q, 6, lists=9, probes=9)
    assert sorted(map(str, near.collect())) == sorted(map(str, vectors.nearest(v, q, 6).collect()))
    assert "NestedLoop" not in near._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_half_up_of_the_shortest_decimal(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(-(10**8), 10**8, 3000) / 1e7, rng.normal(size=500), [-2e-16, 0.0, 1.0000005, 2.0000015]])
    want = [r.y for r in spark.createDataFrame([(i, float(a)) for i, a in enumerate(x)], "i int, x double").select("i", F.round("x", 6).alias("y")).orderBy("i").collect()]
    assert list(map(str, rounded(x, 6).tolist())) == list(map(str, want))


def test_a_text_is_tokenised_once(spark):
    plan = bm25.postings(texts(spark), "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^A-Za-z0-9]+") == 1


def test_an_index_counts_terms_within_tasks(spark, tmp_path, monkeypatch):
    """Postings counted over bytes are those of the text functions, whatever the texts, and no text is shuffled to be counted."""
    rng = np.random.default_rng(9)
    odd = [None, "", "a", "zA", "b", "HTTPServer x9Yz", "var Var tmp", "XA", "bX é字Ab"] + ["".join(rng.choice(list("abCD19 _éß字."), i % 30)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(odd)), "id long, text string").coalesce(2)
    mine, plain = bm25.counted(docs, "id", "text"), bm25.postings(docs, "id", "text")
    assert "Exchange" not in mine._jdf.queryExecution().executedPlan().toString()
    assert mine.schema.fieldNames() == ["id", "term", "dl", "tf"]
    want = sorted(map(str, plain.select(*mine.columns).collect()))
    assert want == sorted(map(str, mine.collect()))
    again = texts(spark)  # identifiers that stand twice, and none
    assert sorted(map(str, bm25.counted(again, "id", "text").collect())) == sorted(map(str, bm25.postings(again, "id", "text").select(*mine.columns).collect()))
    for size in (1, 40):
        monkeypatch.setattr(bm25, "BYTES", size)
        ids, column = pa.array(range(len(odd))), pa.array(odd)
        rows = [r for b in bm25._counted(iter([pa.RecordBatch.from_arrays([ids, column], ["id", "text"])])) for r in b.to_pylist()]
        assert want == sorted(str(Row(**r)) for r in rows)


def test_keyword_results_are_scored_once(spark, small):
    """A query that reads them twice reads what was written."""
    for name in ("ndcg", "grouped_metrics", "append_candidates", "multi_query_rrf"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "_scored" not in plan and "scored(" not in plan


def test_a_first_word_is_read_without_splitting_the_text(spark, small):
    plan = catalog.QUERIES["exact_symbol_candidates"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    of_documents = [line for line in plan.split("\n") if "doc_id" in line]
    assert of_documents and not any(" split(text" in line or "(split(text" in line for line in of_documents)
