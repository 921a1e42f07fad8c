"""Bounded paths are made towards their targets only."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import rows
from gleaner import catalog
from gleaner.operators import traversal

TABLES = "region nation customer supplier part orders lineitem".split()


def test_paths_make_nothing_that_leads_elsewhere(spark, tmp_path):
    """A thousand branches of which one leads to the target: the second hop stores that one, with the same rows and marks as by enumeration."""
    rows = [("s", f"m{i % 10}", "a", 0.9) for i in range(10)] + [(f"m{i % 10}", f"n{i}", "b", 0.8) for i in range(1000)] + [("n7", "t", "c", 0.7), ("s", "t", "d", 0.5), ("m3", "t", "e", 0.6), ("t", "s", "f", 1.0)]
    e = spark.createDataFrame(rows, "src string, dst string, kind string, confidence double")
    ends = spark.createDataFrame([("s", "t"), ("s", "n12"), ("s", "nowhere")], "seed string, target string")
    found = traversal.paths(e, ends, 3, 2, f"file://{tmp_path}/p", beam=10_000)
    got = {(r.target, tuple(r.path), r.weakest, r.truncated) for r in found.collect()}
    assert got == {("t", ("s", "t"), 0.5, True), ("t", ("s", "m3", "t"), 0.6, True), ("n12", ("s", "m2", "n12"), 0.8, False)}
    assert glob.glob(f"{tmp_path}/p/hops/hop=2/*.parquet")
    assert spark.read.parquet(f"file://{tmp_path}/p/hops/hop=2").count() <= 10


def test_paths_lost_to_the_beam_are_marked(spark, tmp_path):
    e = spark.createDataFrame([("s", f"m{i}", "a", 0.5 + i / 100) for i in range(9)] + [(f"m{i}", "t", "b", 0.9) for i in range(9)], "src string, dst string, kind string, confidence double")
    ends = spark.createDataFrame([("s", "t")], "seed string, target string")
    found = traversal.paths(e, ends, 2, 5, f"file://{tmp_path}/p", beam=3).withColumn("via", F.get("path", F.lit(1)))
    assert {(r.via, r.truncated) for r in found.collect()} == {("m8", True), ("m7", True), ("m6", True)}


def _walks(rows, seed, target, depth):
    """All loop-free paths (nodes, kinds, weakest), by enumeration."""
    best = {}
    for s, t, k, c in rows:
        best[s, t, k] = max(c, best.get((s, t, k), 0))
    out, now = [], [((seed,), (), 1.0)]
    for _ in range(depth):
        now = [((*p, t), (*ks, k), min(w, c)) for p, ks, w in now for (s, t, k), c in best.items() if s == p[-1] and t not in p]
        out += [x for x in now if x[0][-1] == target]
    return sorted(out, key=lambda x: (len(x[1]), -x[2], x[0], x[1]))


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_paths_are_those_of_enumeration(spark, tmp_path, depth):
    """Loops, parallel edges, several kinds, ties of confidence, a seed that is its own target, and a node that many tails lead through."""
    draw = random.Random(depth)
    rows = [(f"v{draw.randrange(7)}", f"v{draw.randrange(7)}", draw.choice("ab"), draw.choice([0.3, 0.6, 0.9])) for _ in range(22)]
    rows += [("v1", f"w{i}", "a", 0.9) for i in range(12)] + [(f"w{i}", "v2", "b", [0.3, 0.9][i % 2]) for i in range(12)] + [("v0", "v1", "b", 0.6)]
    pairs = [("v0", "v2"), ("v3", "v2"), ("w3", "v2"), ("v1", "v5"), ("v4", "v4"), ("v0", "nowhere")]
    e = spark.createDataFrame(rows, "src string, dst string, kind string, confidence double")
    found = traversal.paths(e, spark.createDataFrame(pairs, "seed string, target string"), depth, 3, f"file://{tmp_path}/p", beam=10_000)
    got = sorted((r.seed, r.target, tuple(r.path), tuple(r.kinds), r.weakest, r.truncated) for r in found.collect())
    want = sorted((s, t, *x, len(every) > 3) for s, t in pairs for every in [_walks(rows, s, t, depth)] for x in every[:3])
    assert got == want


def test_paths_write_what_is_found_not_the_edges(spark, tmp_path):
    """Of 3,000 edges neither the table nor the unfinished paths are written: pairs, targets, edges into targets and what is told are."""
    rows = [(f"s{i % 100}", f"m{i}", "a", 0.9) for i in range(1500)] + [(f"m{i}", f"t{i % 3}" if i < 30 else f"u{i}", "b", 0.8) for i in range(1500)]
    e = spark.createDataFrame(rows, "src string, dst string, kind string, confidence double")
    ends = spark.createDataFrame([(f"s{i}", f"t{i % 3}") for i in range(30)], "seed string, target string")
    found = traversal.paths(e, ends, 3, 2, f"file://{tmp_path}/p", beam=10_000)
    assert {(r.seed, *r.path) for r in found.collect()} == {(f"s{i}", f"s{i}", f"m{i}", f"t{i % 3}") for i in range(30)}
    tables = {os.path.dirname(f) for f in glob.glob(f"{tmp_path}/p/**/*.parquet", recursive=True)}
    assert sum(spark.read.parquet(f"file://{t}").count() for t in tables) <= 100


def test_keys_too_large_for_numbers(spark, small, tmp_path):
    """Keys beyond a node's number, and negative ones: the same rows as by SQL."""
    for shift in (1 << 61, -1000):
        sf = tmp_path / f"by{shift}"
        for t in TABLES:
            df = spark.read.parquet(f"{small}/{t}.parquet")
            df.withColumns({c: F.col(c) + F.lit(shift) for c in ("l_orderkey", "o_orderkey", "l_partkey") if c in df.columns}).coalesce(1).write.parquet(f"{sf}/{t}.parquet")
        mine = catalog.QUERIES["paths_bounded"](spark, str(sf)).toPandas()
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
        assert len(mine) and rows(mine) == rows(con.execute(catalog.ORACLES["paths_bounded"]).df())
