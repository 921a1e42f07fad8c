"""Centroid clustering of integer vectors by partial-distance search.

Vectors become integers, so every distance and mean is exact and reruns agree whatever the order of rows. Each round is
one pass of tasks over the stored integers: a task holds a tile of vectors and the k centroids, and gives k rows of
counts and sums, which Spark adds up. Within a tile, squared differences are accumulated over the dimensions of highest
variance first (variances are those of all vectors): the centroid that leads after the first block of dimensions is
finished and gives each vector a bound; a centroid whose partial sum is strictly above the bound is abandoned, the others go on
block by block and finish all dimensions. Ties go to the smaller number, so none may be abandoned while it is equal.

The centroids (k times `dims` integers) are all that the driver holds; k is a parameter.

Defined cases: null vectors, vectors of another length and such with null or non-finite components are left out; null
identifiers take part, and are last among the starting candidates; repeated rows are vectors of their own, and may start as
equal centroids (all but the first stay empty); components beyond 2^27 after scaling count as 2^27, so that distances fit
64 bits; with fewer than k vectors each is a centroid; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.shared import drop, stored

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2:"
LIMIT = 1 << 27
#: Dimensions summed between two comparisons with the bound; vectors in a tile.
BLOCK, TILE = 16, 2048


def usable(v: Column, dims: int) -> Column:
    """Whether a vector has `dims` components, all of them finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dims) & finite, F.lit(False))


def integers(v: Column, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; dimensions are taken in the order of the columns."""
    n, dims = x.shape
    k = len(centroids)
    partial = np.zeros((n, k), np.int64)
    for d in range(min(BLOCK, dims)):
        gap = x[:, d, None] - centroids[None, :, d]
        partial += gap * gap
    lead = partial.argmin(1)
    rest = x[:, BLOCK:] - centroids[lead, BLOCK:]
    bound = partial[np.arange(n), lead] + (rest * rest).sum(1)
    alive = partial <= bound[:, None]
    alive[np.arange(n), lead] = False
    row, number = np.nonzero(alive)
    sums = partial[row, number]
    for at in range(BLOCK, dims, BLOCK):
        gap = x[row, at : at + BLOCK] - centroids[number, at : at + BLOCK]
        sums += (gap * gap).sum(1)
        on = sums <= bound[row]
        row, number, sums = row[on], number[on], sums[on]
    np.minimum.at(bound, row, sums)
    on = sums == bound[row]
    best = np.where(partial[np.arange(n), lead] + (rest * rest).sum(1) == bound, lead, k)
    np.minimum.at(best, row[on], number[on])
    return best, bound


def _tiles(batches: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            flat = part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(part.num_rows, -1)[:, order].astype(np.int64)


def _variance_order(kept: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by variance over all vectors, highest first. Only speed depends on it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for part, x in _tiles(batches, np.arange(dims)):
            n, s, q = n + part.num_rows, s + x.sum(0), q + (x.astype(np.float64) ** 2).sum(0)
        yield pa.RecordBatch.from_pydict({"d": np.arange(dims, dtype=np.int32), "n": np.full(dims, float(n)), "s": s, "q": q})

    found = kept.select("v").mapInArrow(work, "d int, n double, s double, q double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    spread = np.zeros(dims)
    for r in found:
        spread[r.d] = r.q - r.s * r.s / r.n if r.n else 0.0
    return np.argsort(-spread, kind="stable")


def _moved(kept: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of each non-empty cluster's mean."""
    k, dims = centroids.shape
    near, names = centroids[:, order], [f"s{d}" for d in range(dims)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _tiles(batches, order):
            best, _ = nearest(x, near)
            for c in np.unique(best):
                mine = x[best == c]
                n[c] += len(mine)
                s[c, order] += mine.sum(0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"c": at.astype(np.int32), "n": n[at], **{name: s[at, d] for d, name in enumerate(names)}})

    parts = kept.select("v").mapInArrow(work, "c int, n long, " + ", ".join(f"{x} long" for x in names))
    out = centroids.copy()
    for r in parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).collect():
        out[r.c] = [r[x] // r.n for x in names]
    return out


def cluster(vectors: DataFrame, id_col="vec_id", vector_col="embedding", k=K, rounds=ROUNDS, dims=DIMS, scale=SCALE, seed=SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) for each usable vector, the final centroids).

    Centroids start as the k vectors with the smallest sha256 of `seed` and identifier; each of `rounds` rounds assigns
    all vectors and moves the centroids, then vectors are assigned once more.
    """
    v, spark = F.col(vector_col), vectors.sparkSession
    kept = stored(vectors.filter(usable(v, dims)).select(F.col(id_col).alias("id"), integers(v, scale).alias("v")), "cluster-vectors")
    first = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    start = kept.select(first.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    kind = next(f.dataType for f in kept.schema.fields if f.name == "id")
    out = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not start:
        drop(kept)
        return spark.createDataFrame([], out), np.zeros((0, dims), np.int64)
    centroids, order = np.array([r.v for r in start], np.int64), _variance_order(kept, dims)
    for _ in range(rounds):
        centroids = _moved(kept, centroids, order)
    near = centroids[:, order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _tiles(batches, order):
            best, distance = nearest(x, near)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), pa.array(best.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    found = stored(kept.mapInArrow(work, out), "clusters")
    drop(kept)
    return found, centroids


def report(found: tuple[DataFrame, np.ndarray], id_col="vec_id") -> DataFrame:
    """Each vector's cluster and distance, the inertia of its cluster and of all, and the digest of its centroid."""
    assigned, centroids = found
    per = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows at most
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    rows = [(c, own, sum(per.values()), digest(c)) for c, own in sorted(per.items())]
    table = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k=K, rounds=ROUNDS, dims=DIMS, scale=SCALE, seed=SEED) -> str:
    """The same rows in SQL, a pair of common tables a round."""
    gap = "CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    finite = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {finite})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{seed}' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r}(vec_id, v, best) AS MATERIALIZED (SELECT x.vec_id, x.v, arg_min({{'c': c.c, 'd': {gap}}}, {{'d': {gap}, 'c': c.c}}) FROM kept x CROSS JOIN c{r} c GROUP BY x.vec_id, x.v)")
        if r < rounds:
            sums = f"SELECT c, list(m ORDER BY d) AS v FROM (SELECT best.c AS c, d, CAST(floor(CAST(sum(v[d]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{r}, unnest(range(1, {dims + 1})) AS t(d) GROUP BY best.c, d) GROUP BY c"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN ({sums}) n ON n.c = o.c)")
    last = f"""SELECT a.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""
    return "WITH " + ",\n".join(parts) + "\n" + last
