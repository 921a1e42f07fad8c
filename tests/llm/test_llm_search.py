"""Periodic runs, clustering and the vector join against brute force, and their defined cases."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import clustering, embedding_join, periodic_runs, registry
from llm.helpers import union_find


def all_runs(w, least=24, exponent=3):
    """Every period tried at every place."""
    n, found = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def edited(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def told(doc_id, w):
    """The row of the report, by the definition."""
    found = all_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    tops = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *tops, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for trial in range(400):
        w = [rng.choice("ab" if trial % 3 else "abcdefgh") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 20))]
            w += (unit * rng.randint(2, 9))[: rng.randint(1, 90)] + [rng.choice("abcdz") for _ in range(rng.randint(0, 9))]
        assert periodic_runs.in_words(w) == all_runs(w)
        assert periodic_runs.in_words(w, 6, 2) == all_runs(w, 6, 2)


def test_mask_keeps_every_repeated_gram():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 5, 16, 21):
        w = rng.integers(0, 3 if k < 6 else 2, 200)
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        want = np.zeros(len(w), bool)
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                want[i : i + k] = True
        assert (periodic_runs.mask(w, k) == want).all()


def test_periodic_runs_query(spark, small):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    got = registry.QUERIES["op11_periodic_runs"](spark, small)
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, got.collect()))
    cut = {d: edited(d, t) for d, t in docs}
    short = [d for d in cut if len(cut[d]) < 2500]  # the plain definition takes the square of the words
    assert len(short) > 0.9 * len(docs) and len(got) == len(docs)
    by = {r[0]: r for r in got}
    assert all(by[d] == told(d, cut[d]) for d in short) and sum(r[1] > 0 for r in got) > 10
    for d in set(cut) - set(short):
        assert by[d][1] == len(periodic_runs.in_words(cut[d]))


def test_periodic_runs_defined_cases(spark):
    line = "one two\tthree\n"
    rows = [(None, None), (1, ""), (2, " \n "), (3, line * 20_000 + "end"), (3, line * 8), (3, line * 8), (4, "x " * 23), (5, "x " * 24), (6, "é " * 30 + "\u00a0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.lit("mine")).withColumn("runs", F.lit(1))
    got = periodic_runs.find(docs, keep=("__text",)).collect()
    by = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.text) for r in got), key=str)
    assert all(r["__text"] == "mine" for r in got) and len(by) == len(rows)
    assert (None, [], "") in by and (1, [], "") in by and (2, [], "") in by
    assert (3, [(0, 60_000, 3)], "one two three end") in by and by.count((3, [(0, 24, 3)], "one two three")) == 2
    assert (4, [], " ".join("x" * 23)) in by and (5, [(0, 24, 1)], "x") in by and (6, [(0, 30, 1)], "é  ") in by
    assert periodic_runs.report(periodic_runs.find(docs.limit(0))).count() == 0


def plain_clusters(vectors, k=40, rounds=5):
    """Full distances in whole numbers; vectors maps identifiers to lists."""
    x = {i: [math.floor(256 * c) for c in v] for i, v in vectors.items()}
    centroids = [x[i] for i in sorted(x, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for v in x.values():
            members.setdefault(nearest(v)[1], []).append(v)
        for n, vs in members.items():
            centroids[n] = [sum(c) // len(vs) for c in zip(*vs)]
    return {i: nearest(v) for i, v in x.items()}, centroids


def test_clusters_equal_plain_distances(spark):
    rng = np.random.default_rng(5)
    spots = rng.normal(0, 1, (6, 64))
    vectors = {i: (spots[i % 6] + rng.normal(0, 0.2, 64)).astype(np.float32).tolist() for i in range(150)}
    vectors |= {200 + i: [0.0] * 64 for i in range(60)}  # ties between equal centroids
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(5)
    want, centroids = plain_clusters(vectors)
    assigned, found = clustering.cluster(df)
    assert {r.id: (r.distance, r.cluster) for r in assigned.collect()} == want and found.tolist() == centroids
    out = clustering.report((assigned, found)).collect()
    total = sum(d for d, _ in want.values())
    assert all(r.inertia == total and r.cluster_inertia == sum(d for d, c in want.values() if c == r.cluster) for r in out)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in out)


def test_partial_distances_abandon_only_strictly_farther():
    rng = np.random.default_rng(6)
    x, c = rng.integers(-3, 4, (500, 64)), rng.integers(-3, 4, (40, 64))
    c[7] = c[3]
    x[:40] = c
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    best, distance = clustering.nearest(x.astype(np.int64), c.astype(np.int64))
    assert (best == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_clustering_defined_cases(spark):
    good, nan, inf = [0.5] * 64, [float("nan")] + [0.5] * 63, [float("inf")] + [0.5] * 63
    rows = [(1, good, 1), (1, good, 2), (None, [-0.5] * 64, 3), (2, None, 4), (3, [0.5] * 63, 5), (4, nan, 6), (5, inf, 7), (6, [None] + [0.5] * 63, 8), (7, [1e30] * 64, 9), (8, [], 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int").withColumn("cluster", F.lit("x")).withColumn("id", F.lit(0))
    out = clustering.report(clustering.cluster(df))
    got = sorted((str(r.vec_id), r.cluster, r.distance) for r in out.collect())
    assert [g[0] for g in got] == ["1", "1", "7", "None"] and all(g[2] == 0 for g in got) and got[0][1] == got[1][1]
    empty = clustering.report(clustering.cluster(df.limit(0)))
    assert empty.count() == 0 and empty.columns == out.columns


def test_vectors_link_as_in_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for label in (0, 1):
        spots = rng.normal(0, 1, (8, 64))
        for k in range(500):
            v = spots[k % 8] + rng.normal(0, rng.choice([0.05, 0.2, 0.35]), 64) if k % 3 else rng.normal(0, 1, 64)
            rows.append((len(rows), v.astype(np.float32).tolist(), label))
    rows += [(len(rows) + k, rows[5][1], 0) for k in range(40)]  # one vector many times
    rows = [(i, v, 0 if i < 900 else lab) for i, v, lab in rows]  # a hot label
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(hit, False)
    root = union_find(len(rows), zip(*np.nonzero(np.triu(hit))))
    want = {(i, int(hit[i].sum()), root[i]) for i in range(len(rows))}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)
    assert hit.sum() > 5000
    for cell, chunk in ((50, 20), (10_000, 64), (200, 4096)):
        got = embedding_join.join(df, cell=cell, chunk=chunk)
        assert {tuple(r) for r in got.select("id", "n_links", "component").collect()} == want, (cell, chunk)


def test_pivots_prune_where_vectors_cluster(spark):
    """Tight far-apart spots: no class is copied to another cell."""
    rng = np.random.default_rng(8)
    spots = rng.normal(0, 1, (20, 64))
    rows = [(k, (spots[k % 20] + rng.normal(0, 0.01, 64)).tolist(), 1) for k in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    v = F.col("embedding")
    classes = df.select(F.lit("64|1").alias("group"), v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    cells = embedding_join._cells(classes, math.sqrt(0.14), 25, 4096)
    assert cells.homes["64|1"].sum() == 1000 and (cells.homes["64|1"] > 0).sum() >= 15 and cells.copies["64|1"].sum() < 4000
    got = embedding_join.join(df, cell=25)
    assert {(r.component, r.n_links) for r in got.collect()} == {(k, 49) for k in range(20)}


def test_vector_join_defined_cases(spark):
    a, b = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    odd = [(20, None, 1), (21, [0.0, 0.0, 0.0], 1), (22, [1.0, None, 0.5], 1), (23, [1.0, float("nan"), 0.5], 1), (24, [float("inf"), 0.0, 0.5], 1), (25, [], 1), (26, a, None), (27, [1.0, 0.0], 1)]
    rows = [(3, a, 1), (2, b, 1), (2, a, 1), (9, a, 2), (None, b, 2), (8, [x * 1e30 for x in a], 3), (7, [x * 1e-30 for x in b], 3), (6, [-1.0, 0.0, -0.5], 3), *odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("h", F.lit(1)).withColumn("n_links", F.lit("x"))
    got = embedding_join.report(embedding_join.join(df))
    out = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got.collect())
    assert out == sorted(
        [("3", 2, 2, False), ("2", 2, 2, True), ("2", 2, 2, True), ("9", 1, 9, True), ("None", 1, 9, False), ("8", 1, 7, False), ("7", 1, 7, True), ("6", 0, 6, True)]
        + [(str(r[0]), 0, r[0], True) for r in odd]
    )
    assert embedding_join.report(embedding_join.join(df.limit(0))).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.99])
def test_links_of_a_task_equal_all_pairs(least):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (1200, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight, right = rng.integers(1, 5, 1200), rng.random(1200) < 0.3
    for side in (None, right):
        hit = x @ x.T >= least
        np.fill_diagonal(hit, False)
        if side is not None:
            hit &= side[:, None] != side[None]
        count, edges = embedding_join.links(x, weight, side, least)
        assert (count == hit @ weight).all()
        assert union_find(1200, edges) == union_find(1200, zip(*np.nonzero(hit)))
