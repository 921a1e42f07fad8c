"""Nearest neighbours of query vectors: exact, and by inverted lists of cluster centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.best import Best
from gleaner.functions.joins import bounded, top
from gleaner.functions.text import tokens, without_stop_words
from gleaner.sources import segments

#: Query vectors and best rows up to which tasks compare with all queries at once; distances of a step.
QUERIES, KEPT, CELLS = 20_000, 1 << 20, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "cosine":
        return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(dot(gap, gap))


def score_of(d: Column, metric: str) -> Column:
    """Distance to a score from 0 to 1."""
    return 1 - d / 2 if metric == "cosine" else 1 / (1 + d)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, distance, score, rank): a stated query set against all rows, of which each task keeps k rows a query.

    Queries beyond the bounds, and queries or rows with null or non-finite components, are compared pair by pair.
    """
    own = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = queries.select(F.col(id_col).alias("query"), F.col(vec_col).cast("array<double>").alias("qv"))
    rows = asked.limit(QUERIES + 1).collect()  # a bounded number
    clean = [r for r in rows if r.qv is not None and all(x is not None and np.isfinite(x) for x in r.qv)]
    if len(rows) > QUERIES or len(rows) * k > KEPT or len(clean) < len(rows):
        scored = _pairs(own, asked, metric)
    else:
        odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        work = own.sparkSession.sparkContext.broadcast((_by_size(clean, metric), len(clean), k, metric))
        names = own.sparkSession.createDataFrame([(i, r.query) for i, r in enumerate(clean)], f"q int, query {asked.schema['query'].dataType.simpleString()}")
        of_task = own.filter(~odd).mapInArrow(_nearest(work), f"id {own.schema['id'].dataType.simpleString()}, q int, distance double")
        scored = of_task.join(F.broadcast(names), "q").select("query", "id", "distance").unionByName(_pairs(own.filter(odd), asked, metric))
    ranked = top(scored, k, ["query"], F.col("distance"), F.col("id"))
    return ranked.select("query", "id", "distance", F.round(score_of(F.col("distance"), metric), 7 if metric == "cosine" else 6).alias("score"), "rank")


def _pairs(own: DataFrame, asked: DataFrame, metric: str) -> DataFrame:
    """(query, id, distance) of every pair of one length."""
    made = unit_vector if metric == "cosine" else (lambda v: v)  # each side is brought to unit length once, not once a pair
    pairs = own.select("id", made(F.col("v")).alias("v")).crossJoin(bounded(asked.select("query", made(F.col("qv")).alias("qv")))).filter(F.size("v") == F.size("qv"))
    d = _cosine(F.col("v"), F.col("qv")) if metric == "cosine" else F.round(distance(F.col("v"), F.col("qv"), metric), 6)
    return pairs.select("query", "id", d.alias("distance"))


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _by_size(rows: list, metric: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers and vectors of the queries of each length."""
    sizes = np.array([len(r.qv) for r in rows], np.int64)
    out = {}
    for m in set(sizes.tolist()):
        at = np.flatnonzero(sizes == m)
        x = np.array([rows[i].qv for i in at], np.float64).reshape(len(at), m)
        out[m] = at, _units(x) if metric == "cosine" else x
    return out


def _distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1 - x @ y.T
    return np.stack([np.sqrt(((x - q) ** 2).sum(1)) for q in y], 1)


def _nearest(work):
    """The best rows (id, q, distance) of vectors (id, v)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, n, k, metric = work.value
        kept = Best(n, k, 6)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            told = column.is_valid().to_numpy(zero_copy_only=False)
            for m, (at, y) in asked.items():
                own = np.flatnonzero(told & (sizes == m))
                step = max(1, CELLS // len(at))
                for lo in range(0, len(own), step):
                    part = own[lo : lo + step]
                    x = column.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), m)
                    d = _distances(_units(x) if metric == "cosine" else x, y, metric)
                    kept.add(np.tile(at, len(part)), d.ravel(), ids, np.repeat(part, len(at)))
        if len(kept.group):
            yield pa.RecordBatch.from_arrays([kept.ids, pa.array(kept.group.astype(np.int32)), pa.array(kept.value)], ["id", "q", "distance"])

    return found


def centres_of(vectors: DataFrame, lists: int, sample: int, vec_col: str, id_col: str) -> np.ndarray:
    """Unit centres fitted on at most `sample` rows, chosen by a hash of the id; the sample bounds what reaches the driver."""
    some = vectors.orderBy(F.xxhash64(id_col)).limit(sample).select(vec_col).toPandas()[vec_col]
    x = np.array(some.tolist(), dtype=np.float64)
    if not len(x):
        return np.zeros((0, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(8):
        own = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (own == c).any():
                m = x[own == c].mean(0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    return centres


def in_lists(vectors: DataFrame, centres: np.ndarray, n: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, list): each vector in its n nearest lists."""
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def work(batches):
        for b in batches:
            if len(b):
                v = np.array(b["v"].tolist(), dtype=np.float64)
                b["list"] = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :n].tolist()
                yield b

    return plain.mapInPandas(work, f"id {plain.schema['id'].dataType.simpleString()}, v array<double>, list array<int>").withColumn("list", F.explode("list"))


def lists_for(rows: int) -> int:
    """Lists for so many vectors: about the square root, so a list stays near as many rows as there are lists."""
    return max(1, min(65_536, round(rows**0.5)))


def probes_for(lists: int) -> int:
    """Lists that a query reads: most of a few, and a share that falls with their number."""
    return min(lists, max(8, round(4 * lists**0.5)))


def build_lists(vectors: DataFrame, path: str, lists: int | None = None, sample: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Write every vector under its nearest centre, one folder a list, and the centres, fitted on at most `sample` rows (32 a list)."""
    lists = lists or lists_for(vectors.count())
    centres = centres_of(vectors, lists, sample or 32 * lists, vec_col, id_col)
    rows = in_lists(vectors, centres, 1, id_col, vec_col)
    segments.put(path, 0, rows, rows.select("id").limit(0), ("list",))
    vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def _centres(spark, path: str) -> np.ndarray:
    return np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()])  # one row a list


def add_to_lists(spark, path: str, segment: int, vectors: DataFrame, gone: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Append vectors to written lists and remove ids (a column id); centres stay as they were fitted."""
    segments.put(path, segment, in_lists(vectors, _centres(spark, path), 1, id_col, vec_col), gone, ("list",))


def nearest_built(spark, path: str, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", segment: int = 0) -> DataFrame:
    """(query, id, distance, score, rank) from written lists: each query reads `probes` of them, the others are pruned."""
    centres = _centres(spark, path)
    probes = probes or probes_for(len(centres))
    q = in_lists(queries, centres, min(probes, len(centres)), id_col, vec_col).select(F.col("id").alias("query"), unit_vector(F.col("v")).alias("qv"), "list")
    rows = segments.live(spark, path, "id", segment).withColumn("v", unit_vector(F.col("v")))
    return _ranked(_in_one_list(rows.select("id", "v", "list"), q, k), k)


def _cosine(a: Column, b: Column) -> Column:
    """Distance of two unit vectors."""
    return F.round(1 - dot(a, b), 6)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    ranked = top(scored, k, ["query"], F.col("distance"), F.col("id"))
    return ranked.select("query", "id", "distance", F.round(score_of(F.col("distance"), "cosine"), 7).alias("score"), "rank")


def nearest_by_lists(vectors: DataFrame, queries: DataFrame, k: int, lists: int | None = None, probes: int | None = None, sample: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """As nearest (cosine), approximately and without a written index: every row is in one list, every query reads `probes` lists."""
    lists = lists or lists_for(vectors.count())
    centres = centres_of(vectors, lists, sample or 32 * lists, vec_col, id_col)
    if not len(centres):
        return nearest(vectors, queries, k, "cosine", id_col, vec_col)
    v = in_lists(vectors, centres, 1, id_col, vec_col).withColumn("v", unit_vector(F.col("v")))
    q = in_lists(queries, centres, min(probes or probes_for(len(centres)), len(centres)), id_col, vec_col).select(F.col("id").alias("query"), unit_vector(F.col("v")).alias("qv"), "list")
    return _ranked(_in_one_list(v, q, k), k)


def _in_one_list(v: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """(query, id, distance): of each list, the k best rows (id, v, list) for each query (query, qv, list) that reads it.

    Lists are dealt out with their queries first; a task holds a list's queries and passes over its rows.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    both = q.select("list", F.lit(0).alias("side"), "query", none(v, "id").alias("id"), F.col("qv").alias("v"))
    both = both.unionByName(v.select("list", F.lit(1).alias("side"), none(q, "query").alias("query"), "id", "v"))
    types = {c: both.schema[c].dataType.simpleString() for c in ("query", "id")}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, held, kept = None, [], [], None

        def ended() -> Iterator[pa.RecordBatch]:
            if kept is not None and len(kept.group):
                every = pa.concat_arrays(names)
                yield pa.RecordBatch.from_arrays([every.take(pa.array(kept.group)), kept.ids, pa.array(kept.value)], ["query", "id", "distance"])

        for batch in batches:
            lists, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((lists[1:] != lists[:-1]) | (sides[1:] != sides[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(lists)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                x = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                if lists[lo] != now:
                    yield from ended()
                    now, names, held, kept = lists[lo], [], [], None
                if not sides[lo]:
                    names, held = [*names, part.column(2)], [*held, x]
                elif held:
                    if kept is None:
                        held = [np.concatenate(held)]
                        kept = Best(len(held[0]), k, 6)
                    y, step = held[0], max(1, CELLS // len(held[0]))
                    for at in range(0, len(x), step):
                        d = 1 - x[at : at + step] @ y.T
                        kept.add(np.tile(np.arange(len(y)), len(d)), d.ravel(), part.column(3), np.repeat(np.arange(at, at + len(d)), len(y)))
        yield from ended()

    return both.repartition("list").sortWithinPartitions("list", "side").mapInArrow(found, f"query {types['query']}, id {types['id']}, distance double")


def static_embedding(texts: DataFrame, id_col: str, text_col: str, dims: int = 256) -> DataFrame:
    """(id, embedding): hashed tokens (weight 0.7) and letter-digit byte trigrams (0.3), FNV-1 64-bit, L2-normalised."""
    def fnv(raw: bytes) -> int:
        h = 0xCBF29CE484222325
        for b in raw:
            h = (h * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF ^ b
        return h

    def work(batches):
        known: dict[bytes, int] = {}

        def place(raw: bytes) -> int:
            if raw not in known:
                if len(known) > 200_000:
                    known.clear()
                known[raw] = fnv(raw) % dims
            return known[raw]

        for b in batches:
            out = []
            for toks, text in zip(b["toks"], b["text"], strict=True):
                v = np.zeros(dims)
                for t in toks:
                    v[place(t.encode())] += 0.7
                raw = "".join(c for c in (text or "").lower() if c.isalpha() or c.isdigit()).encode()
                for i in range(len(raw) - 2):
                    v[place(raw[i : i + 3])] += 0.3
                norm = np.linalg.norm(v)
                out.append((v / norm if norm else v).astype(np.float32).tolist())
            yield pd.DataFrame({"id": b["id"], "embedding": out})

    plain = texts.select(F.col(id_col).alias("id"), without_stop_words(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("toks"), F.col(text_col).alias("text"))
    return plain.mapInPandas(work, "id long, embedding array<float>")
