"""Bounded neighbours read a hub once, not for each seed that comes to it."""

import glob
import os
import random

import pytest

from gleaner.operators import traversal


def _around(rows, seed, depth, limit):
    """(node, depth, confidence) and whether more were found, hop by hop as the operator's docstring states."""
    best = {}
    for s, t, c in rows:
        for a, b in ((s, t), (t, s)):
            best[a, b] = max(c, best.get((a, b), 0))
    seen, out, now, cut = {seed}, [], {seed: 1.0}, False
    for d in range(1, depth + 1):
        new = {}
        for (a, b), c in best.items():
            if a in now and b not in seen:
                new[b] = max(min(now[a], c), new.get(b, 0))
        ranked, room = sorted(new.items(), key=lambda x: (-x[1], x[0])), limit - len(out)
        cut, now = len(ranked) > room, dict(ranked[:room])
        out += [(n, d, c) for n, c in now.items()]
        seen |= set(now)
        if cut:
            break
    return out, cut


@pytest.mark.parametrize("limit", [1, 4, 9, 60])
def test_neighbours_are_those_of_enumeration(spark, tmp_path, limit):
    """Hubs of several sureties, parallel edges, loops, and seeds that are full at different hops."""
    draw = random.Random(limit)
    rows = [(f"v{draw.randrange(40)}", f"v{draw.randrange(40)}", draw.choice([0.3, 0.6, 0.9])) for _ in range(45)]
    rows += [(f"v{i}", "hub", draw.choice([0.5, 0.8, 0.95])) for i in range(0, 40, 2)] + [("hub", f"w{i}", draw.choice([0.2, 0.7, 1.0])) for i in range(60)]
    e = spark.createDataFrame(rows, "src string, dst string, confidence double")
    seeds = [f"v{i}" for i in range(15)] + ["w3", "alone"]
    found = traversal.neighbours(e, spark.createDataFrame([(s,) for s in seeds], "seed string"), 3, limit, f"file://{tmp_path}/n")
    got = sorted((r.seed, r.node, r.depth, r.confidence, r.truncated) for r in found.collect())
    assert got == sorted((s, *x, cut) for s in seeds for out, cut in [_around(rows, s, 3, limit)] for x in out)


def test_neighbours_write_hops_only_and_give_few_of_a_hub(spark, tmp_path):
    """Of 2,000 edges at a hub that 50 seeds come to, none is written; the hub gives limit + 2 neighbours for each so_far."""
    rows = [(f"s{i}", "hub", 0.9) for i in range(50)] + [("hub", f"w{i}", [0.5, 0.95][i % 2]) for i in range(2000)]
    e = spark.createDataFrame(rows, "src string, dst string, confidence double")
    found = traversal.neighbours(e, e.filter("dst = 'hub'").selectExpr("src AS seed"), 3, 5, f"file://{tmp_path}/n")
    assert found.filter("truncated").count() == 250
    tables = {os.path.dirname(f) for f in glob.glob(f"{tmp_path}/n/**/*.parquet", recursive=True)}
    assert sum(spark.read.parquet(f"file://{t}").count() for t in tables) <= 50 * 7
    tips = spark.createDataFrame([("hub", 0.9), ("hub", 0.4)], "src string, so_far double")
    near = traversal._nearest(e, tips, 7, lambda n: n).groupBy("so_far").count().collect()
    assert {(r.so_far, r["count"]) for r in near} == {(0.9, 7), (0.4, 7)}
