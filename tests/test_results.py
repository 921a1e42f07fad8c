"""Presentation of results on literal inputs."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gleaner.operators import results as R


def test_highlights_are_places_in_order(spark):
    rows = [("Ab ab AB x", ["ab", "x", "AB"]), (None, ["a"]), ("abc", None), ("a" * 50, ["a"])]
    got = spark.createDataFrame(rows, "t string, w array<string>").select(R.highlight_spans(F.col("t"), F.col("w")).alias("s")).collect()
    assert [tuple(x) for x in got[0].s] == [(0, 2), (3, 5), (6, 8), (9, 10)] and got[1].s == got[2].s == [] and len(got[3].s) == R.HIGHLIGHTS


def test_paths_and_roles(spark):
    d = spark.createDataFrame([(["a", "b", "c"], ["lives_in", "file_imports"])], "p array<string>, k array<string>")
    r = d.select(R.path_text(F.col("p"), F.col("k")).alias("t"), R.roles(F.col("k")).alias("r")).first()
    assert r.t == "a -[lives_in]-> b -[file_imports]-> c" and r.r == ["importer", "place"]


def test_vectors_are_replaced_refused_and_removed(spark):
    s = "vec_id long, embedding array<float>"
    old, new = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0])], s), spark.createDataFrame([(1, [0.0, 2.0]), (3, [1.0])], s)
    kept, refused = R.put_vectors(old, new, spark.createDataFrame([(2,)], "vec_id long"), 2)
    assert {r.vec_id: r.embedding for r in kept.collect()} == {1: [0.0, 1.0], 4: [0.0, 0.0]} and [r.vec_id for r in refused.collect()] == [3]


def test_reports_are_not_overwritten(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    R.write_report(spark.range(2), path)
    with pytest.raises(AnalysisException):
        R.write_report(spark.range(3), path)
    R.write_report(spark.range(3), path, replace=True)
    assert spark.read.json(path).count() == 3
