"""Near-duplicate vectors by an exact metric range join under each label.

Cosine at least c means that unit vectors lie within r = sqrt(2 - 2c) of each other. Equal vectors of a label become one
class with a count first, so copies cost one row. Labels of many classes get pivots: a hashed sample, thinned
farthest-first. A class's home is the cell of its nearest pivot, and it is copied to an earlier cell j only if a
neighbour may live there: by the triangle inequality its distance to pivot j is then at most r more than the farthest
home member's, and it lies within r of the border between both cells. So each pair meets in one cell, that of the
smaller number. Cells join independently; one of over CHUNK rows (a dense spot that no pivot parts) is dealt as pairs of
chunks, so that no task holds more than two chunks. Within a task, rows are sorted by their distance to one of them, and only
those within r of it (the triangle inequality again) are multiplied, in single precision; dot products too near to c
to be sure are computed again in double precision. A task gives counts of links and the edges of a spanning forest, never all pairs.

Pivots bound copies where vectors cluster. Where all of a label's vectors point in unlike directions (64 independent dimensions,
as in the given tables), distances to pivots hardly differ, almost every class is copied to almost every earlier cell, and the
join is quadratic in the label's distinct vectors; no exact metric partition avoids that.

Defined cases: a null label, a null, empty or zero vector, and one with null or non-finite components link with nothing; nor do
vectors of different length; rows with equal identifiers are vectors of their own (each counts as another); null
identifiers take part but are never a component's name unless all are null; an empty table gives an empty result; other
columns are ignored. Rows find their class again by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import connected, drop, look_up, parted, stored, unit

LEAST = 0.93
#: Classes a cell should hold, pivots of all labels together, and rows of a task's chunk.
CELL, MAX_PIVOTS, CHUNK = 1024, 4096, 4096
ROWS = 512  # of a block of dot products
SLACK = 1e-6


def linkable(v: Column) -> Column:
    """Whether a vector has a direction: components there and finite, one of them not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _directions(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(group, rows, unit vectors) for each group of a batch; vectors of a group have one length."""
    coded = batch.column(batch.schema.get_field_index("group")).dictionary_encode()
    lists = batch.column(batch.schema.get_field_index("v"))
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(rows):
            dims = ends[rows[0] + 1] - ends[rows[0]]
            yield coded.dictionary[int(codes[rows[0]])].as_py(), rows, _directions(flat[ends[rows][:, None] + np.arange(dims)])


def _spread(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k of the vectors, each the farthest from those before it."""
    chosen, far = [0], 2 - 2 * (x @ x[0])
    while len(chosen) < k:
        at = int(far.argmax())
        if far[at] <= SLACK:
            break
        chosen.append(at)
        far = np.minimum(far, 2 - 2 * (x @ x[at]))
    return x[chosen]


class Cells:
    """Pivots of the labels with many classes, and what is known of their cells."""

    def __init__(self, pivots: dict[str, np.ndarray], r: float, sizes: dict[str, int]):
        self.pivots, self.r, self.sizes = pivots, r, sizes
        self.gaps = {g: np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0)) for g, p in pivots.items()}
        self.radius = {g: np.zeros(len(p)) for g, p in pivots.items()}
        self.homes = {g: np.zeros(len(p), np.int64) for g, p in pivots.items()}
        self.copies = {g: np.zeros(len(p), np.int64) for g, p in pivots.items()}

    def home(self, group: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home, distance to its pivot, cosines to all pivots)."""
        cos = x @ self.pivots[group].T
        at = cos.argmax(1)
        return at, np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(x)), at], 0)), cos

    def copied(self, group: str, at: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every copy: the earlier cells in which a neighbour may live."""
        own = cos[np.arange(len(at)), at]
        reach = np.sqrt(np.maximum(2 - 2 * cos, 0)) <= self.radius[group] + self.r + SLACK
        border = own[:, None] - cos <= (self.r + SLACK) * self.gaps[group][at] + SLACK
        return np.nonzero(reach & border & (np.arange(cos.shape[1]) < at[:, None]))


def _cells(classes: DataFrame, r: float, cell: int, max_pivots: int) -> Cells:
    """Choose pivots and measure cells; what reaches the driver is bounded by `max_pivots`."""
    total = classes.count()
    cell = max(cell, -(-total // max_pivots))
    many = classes.groupBy("group").agg(F.count("*").alias("size")).filter(F.col("size") > cell)
    sizes = {x.group: x.size_ for x in many.withColumnRenamed("size", "size_").collect()}  # total / cell labels at most
    if not sizes:
        return Cells({}, r, sizes)
    want = {g: -(-n // cell) for g, n in sizes.items()}
    rates = classes.sparkSession.createDataFrame([(g, min(1.0, 4.0 * want[g] / n)) for g, n in sizes.items()], "group string, rate double")
    some = classes.join(F.broadcast(rates), "group").filter(unit(F.col("h1"), F.col("h2")) < F.col("rate")).select("group", "h1", "v")
    sample: dict[str, list] = {}
    for x in sorted(some.collect(), key=lambda x: (x.group, x.h1)):  # about four a pivot
        sample.setdefault(x.group, []).append(x.v)
    cells = Cells({g: _spread(_directions(np.array(v)), want[g]) for g, v in sample.items()}, r, sizes)
    large = classes.join(F.broadcast(rates.select("group")), "group").select("group", "v")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, rows, x in _by_group(batch):
                if g in cells.pivots:
                    at, far, _ = cells.home(g, x)
                    k = len(cells.pivots[g])
                    most = np.zeros(k)
                    np.maximum.at(most, at, far)
                    yield pa.RecordBatch.from_pydict({"g": [g] * k, "cell": np.arange(k, dtype=np.int32), "n": np.bincount(at, minlength=k), "far": most})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, rows, x in _by_group(batch):
                if g in cells.pivots:
                    at, _, cos = cells.home(g, x)
                    k = len(cells.pivots[g])
                    yield pa.RecordBatch.from_pydict({"g": [g] * k, "cell": np.arange(k, dtype=np.int32), "n": np.bincount(cells.copied(g, at, cos)[1], minlength=k), "far": np.zeros(k)})

    def gathered(work) -> list:
        return large.mapInArrow(work, "g string, cell int, n long, far double").groupBy("g", "cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()

    for x in gathered(measured):
        cells.homes[x.g][x.cell], cells.radius[x.g][x.cell] = x.n, x.far
    for x in gathered(counted):
        cells.copies[x.g][x.cell] = x.n
    return cells


def _dealt(classes: DataFrame, cells: Cells, chunk: int) -> DataFrame:
    """A row for each class and unit of work it takes part in: group, cell, a, b (chunks), side, key, n, v."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy()
            for g, rows, x in _by_group(batch):
                parts = []  # (row, cell, a, b, side)
                if g not in cells.pivots:
                    at = np.zeros(len(rows), np.int64)
                    n_home = np.array([-(-cells.sizes.get(g, 1) // chunk)])
                    n_copy, copy = np.zeros(1, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
                else:
                    at, _, cos = cells.home(g, x)
                    n_home, n_copy = np.maximum(1, -(-cells.homes[g] // chunk)), -(-cells.copies[g] // chunk)
                    copy = cells.copied(g, at, cos)
                mixed = (keys[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = (mixed % n_home[at].astype(np.uint64)).astype(np.int64)
                i = np.arange(len(rows))
                times = (n_home + n_copy)[at]
                row, turn = np.repeat(i, times), np.concatenate([np.arange(t) for t in times]) if len(times) else i
                parts.append((row, at[row], np.minimum(own[row], turn), np.maximum(own[row], turn), (turn < own[row]).astype(np.int8)))
                row, cell = copy
                if len(row):
                    mine = n_home[cell] + (mixed[row] % n_copy[cell].astype(np.uint64)).astype(np.int64)
                    times = n_home[cell]
                    turn = np.concatenate([np.arange(t) for t in times])
                    parts.append((np.repeat(row, times), np.repeat(cell, times), turn, np.repeat(mine, times), np.ones(len(turn), np.int8)))
                row, cell, a, b, side = (np.concatenate(c) for c in zip(*parts))
                for s in range(0, len(row), 8192):
                    e = slice(s, s + 8192)
                    took = batch.take(pa.array(rows[row[e]]))
                    yield pa.RecordBatch.from_arrays(
                        [took.column(0), pa.array(cell[e].astype(np.int32)), pa.array(a[e].astype(np.int32)), pa.array(b[e].astype(np.int32)), pa.array(side[e]), *took.columns[1:]],
                        ["group", "cell", "a", "b", "side", "key", "n", "v"],
                    )

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select("group", "key", "n", "v").mapInArrow(work, f"group string, cell int, a int, b int, side byte, key long, n long, v {kind}")


def links(x: np.ndarray, weight: np.ndarray, right: np.ndarray | None, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weight of the linked rows of each row, edges of a spanning forest); with `right` only pairs of a right and another row."""
    n, dims = x.shape
    r, eps = np.sqrt(max(0.0, 2 - 2 * least)) + SLACK, 1e-6 + dims * 1.2e-7
    far = np.sqrt(np.maximum(2 - 2 * (x @ x[0]), 0))
    order = np.argsort(far, kind="stable")
    side = np.zeros(n, bool) if right is None else right[order]
    left_at, right_at = (order, order) if right is None else (order[~side], order[side])
    a, b, fa, fb = x[left_at], x[right_at], far[left_at], far[right_at]
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    wa, wb = weight[left_at].astype(np.float64), weight[right_at].astype(np.float64)
    count, root, edges = np.zeros(n), np.arange(n), []
    for s in range(0, len(a), ROWS):
        e = min(s + ROWS, len(a))
        lo, hi = np.searchsorted(fb, fa[s] - r - SLACK), np.searchsorted(fb, fa[e - 1] + r + SLACK, "right")
        if right is None:
            lo = max(lo, s)
        if lo >= hi:
            continue
        dots = a32[s:e] @ b32[lo:hi].T
        near = dots >= least - eps
        if right is None:
            near &= np.arange(lo, hi)[None, :] > np.arange(s, e)[:, None]
        if not near.any():
            continue
        i, j = np.nonzero(near & (dots < least + eps))
        for t in range(0, len(i), 1 << 16):
            p, q = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
            near[p, q] = (a[s + p] * b[lo + q]).sum(1) >= least
        rows = np.flatnonzero(near.any(1))
        hit = near[rows].astype(np.float64)
        np.add.at(count, left_at[s + rows], hit @ wb[lo:hi])
        np.add.at(count, right_at[lo:hi], wa[s + rows] @ hit)
        for k in rows:
            one, others = left_at[s + k], right_at[lo:hi][near[k]]
            if (root[others] != root[one]).any():
                met = np.unique(np.append(root[others], root[one]))
                edges += [(int(met[0]), int(m)) for m in met[1:]]
                root[np.isin(root, met[1:])] = met[0]
    return np.rint(count).astype(np.int64), edges


def _joined(units: DataFrame, least: float) -> DataFrame:
    """(key, links, other): counts of links have no other, edges of the forest no count."""
    names = ["group", "cell", "a", "b"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows < 2:
                return
            cross = rows["a"][0].as_py() != rows["b"][0].as_py()
            right = rows["side"].to_numpy() == 1 if cross else None
            if cross and (right.all() or not right.any()):
                return
            v = rows["v"].combine_chunks()
            x = _directions(v.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1))
            key = rows["key"].to_numpy()
            count, edges = links(x, rows["n"].to_numpy(), right, least)
            at = np.flatnonzero(count)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(count[at]), pa.nulls(len(at), pa.int64())], ["key", "links", "other"])
            if edges:
                pairs = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(key[pairs[:, 0]]), pa.nulls(len(edges), pa.int64()), pa.array(key[pairs[:, 1]])], ["key", "links", "other"])

        last = None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            group = cols[0].dictionary_encode()
            marks = np.stack([group.indices.to_numpy(), *(c.to_numpy() for c in cols[1:])], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                now = (cols[0][s].as_py(), *marks[s, 1:].tolist())
                if now != last and held:
                    yield from settle()
                    held = []
                last = now
                held.append(batch.slice(s, e - s))
        if held:
            yield from settle()

    dealt = units.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(work, "key long, links long, other long")


def join(vectors: DataFrame, id_col="vec_id", label_col="label", vector_col="embedding", least=LEAST, cell=CELL, max_pivots=MAX_PIVOTS, chunk=CHUNK) -> DataFrame:
    """id, n_links (other vectors at a cosine of `least` or more under the same label), component (smallest identifier that links reach)."""
    v, label = F.col(vector_col), F.col(label_col)
    plain = vectors.select(F.col(id_col).alias("id"), label.cast("string").alias("label"), v.alias("v")).withColumn("ok", F.col("label").isNotNull() & linkable(F.col("v")))
    plain = plain.withColumn("h", F.when(F.col("ok"), F.struct(F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(7), "v", "label").alias("h2"))))
    good = plain.filter("ok").select("id", F.concat_ws("|", F.size("v"), "label").alias("group"), "v", "h.h1", "h.h2")
    classes = good.groupBy("h1", "h2", "group", "v").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("key", F.monotonically_increasing_id())
    classes = stored(classes, "vector-classes")
    cells = _cells(classes, float(np.sqrt(max(0.0, 2 - 2 * least))), cell, max_pivots)
    found = stored(_joined(_dealt(classes, cells, chunk), least), "vector-links")
    counts = found.filter("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    roots = stored(connected(found.filter("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")), "vector-components"), "vector-roots")
    small = classes.select("key", "h1", "h2", "n", "least")
    named = roots.join(small.select(F.col("key").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    told = look_up(roots, named, "root", "members", roots.count()).select(F.col("node").alias("key"), "component")
    linked = small.join(counts, "key", "left").join(told, "key", "left").filter("n > 1 OR links > 0")
    linked = stored(linked.select(F.struct("h1", "h2").alias("h"), "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")), "vectors-linked")
    drop(classes, found, roots)
    return _told(plain.select("id", "h"), linked)


def _told(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Each row with what its class was found to link to; copies of one vector by the thousand are looked up by broadcast."""
    maybe, alone = parted(rows, linked, "h")
    hot = linked.filter("n > 10000").orderBy(F.desc("n")).limit(1000)
    first = maybe.join(F.broadcast(hot.select("h", F.struct("n_links", "component").alias("hot"))), "h", "left")
    rest = first.filter("hot IS NULL").join(linked.withColumnRenamed("component", "c"), "h", "left")
    return (
        first.filter("hot IS NOT NULL").select("id", "hot.n_links", "hot.component")
        .unionByName(rest.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("c")).alias("component")))
        .unionByName(alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    )


def report(joined: DataFrame, id_col="vec_id") -> DataFrame:
    return joined.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


#: The same rows in SQL, for tables whose identifiers are unique.
ORACLE = f"""
WITH RECURSIVE usable AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {LEAST}),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l USING (vec_id) LEFT JOIN degrees d ON d.a = e.vec_id
"""
