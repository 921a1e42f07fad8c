"""Bounded walks over a graph: frontiers that are stored each hop, capped for each seed, with what was cut marked.

Every hop joins the frontier with the edges, so plans grow by the same few joins a hop whatever the depth; paths
are made from both ends. Nodes may be ids or numbers; `name` gives the id by which ties are ordered. A seed's answer holds `limit` rows: of a hop's new nodes (or paths) the surest come first, and a seed of
which more were found is marked truncated. The cap is applied below the shuffle on the seed, so a hub with millions
of neighbours sends `limit` rows of each task, and a capped frontier bounds the next hop.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.joins import bounded, sifted, spread, top, within


def _same(node: Column) -> Column:
    return node


def _stored(df: DataFrame, place: str) -> DataFrame:
    df.write.mode("overwrite").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def _taken(found: DataFrame, left: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows of each seed, as many as it has left; one more is kept aside as the sign that some were cut."""
    ranked = top(found, most + 1, ["seed"], *order, rank="at").join(left, "seed")
    return ranked.withColumn("cut", F.col("at") > F.col("left"))


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int, limit: int, place: str, name: Callable[[Column], Column] = _same) -> DataFrame:
    """(seed, node, depth, confidence, truncated): nodes within `depth` hops in either direction, `limit` a seed, the seed not among them.

    A node is given at its least depth, with the greatest of the confidences by which its path's weakest edge comes to it. Seeds that
    are truncated go no further. A hop reads the edges of its frontier's nodes only, and of a node's neighbours those that could be among
    a seed's next rows, so a hub costs its edges once and not for each seed that comes to it. place: a folder that all executors share.
    """
    there = edges.select("src", "dst", "confidence")
    both = there.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))
    frontier = _stored(seeds.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), F.lit(False).alias("cut")), f"{place}/hops/hop=0")
    spark, shape = frontier.sparkSession, frontier.schema
    for d in range(1, depth + 1):
        seen = spark.read.schema(shape).parquet(f"{place}/hops/hop=*")
        left = seen.groupBy("seed").agg((F.lit(limit) - F.count_if(~F.col("cut") & (F.col("depth") > 0))).alias("left"), F.max("cut").alias("full")).filter("NOT full").drop("full")
        most = left.agg(F.max("left")).first()[0]
        if most is None:  # every seed has been cut
            break
        tips = frontier.select("seed", F.col("node").alias("src"), F.col("confidence").alias("so_far")).join(left.select("seed"), "seed", "left_semi")
        near = _nearest(both, tips.select("src", "so_far").distinct(), limit + 2, name)
        new = tips.join(near, ["src", "so_far"]).select("seed", F.col("dst").alias("node"), "confidence").groupBy("seed", "node").agg(F.max("confidence").alias("confidence"))
        new = new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        kept = _taken(new, left, most, F.col("confidence").desc(), name(F.col("node")))
        frontier = _stored(kept.select("seed", "node", F.lit(d).alias("depth"), "confidence", "cut"), f"{place}/hops/hop={d}")
    rows = spark.read.schema(shape).parquet(f"{place}/hops/hop=*")
    cut = rows.filter("cut").select("seed").distinct().withColumn("truncated", F.lit(True))
    out = rows.filter("NOT cut AND depth > 0").join(cut, "seed", "left")
    return out.select("seed", "node", "depth", "confidence", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def _nearest(both: DataFrame, tips: DataFrame, keep: int, name: Callable[[Column], Column]) -> DataFrame:
    """(src, so_far, dst, confidence): of each tip (src, so_far) the first `keep` neighbours by min(so_far, confidence), then by name.

    A seed has seen limit + 1 - left nodes, itself among them, and takes left + 1 at most, so none of its rows comes after limit + 2 neighbours of a
    tip. Of a node's equally sure neighbours no more are needed whatever so_far is, so these are cut before tips are joined.
    """
    edges = sifted(both, "src", tips.select("src")).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    few = top(edges, keep, ["src", "confidence"], name(F.col("dst")), rank="at").drop("at")
    step = few.join(bounded(tips), "src").withColumn("confidence", F.least("so_far", "confidence"))
    return top(step, keep, ["src", "so_far"], F.col("confidence").desc(), name(F.col("dst")), rank="at").drop("at")


def paths(edges: DataFrame, ends: DataFrame, depth: int, limit: int, place: str, beam: int | None = None, name: Callable[[Column], Column] = _same) -> DataFrame:
    """(seed, target, path, kinds, weakest, truncated): loop-free paths along edges between pairs (seed, target), `limit` a pair.

    A path is told by its nodes and kinds of edges: parallel edges of a kind count once, at their greatest confidence. Shorter paths come
    first, then surer ones, then by `name` of their nodes and by kinds. The last hops (two, or one of a depth under 3) are made once for all
    pairs, backwards from the targets; those before go forward from the seeds, and one join on node and target completes both, so that what
    leads elsewhere is never made. Unfinished paths of a pair are kept to `beam` a forward hop (ten times the limit), the surest
    first; a pair of which more paths were found, or that lost unfinished ones, is marked truncated.
    """
    beam = beam or 10 * limit
    back = min(2, (depth + 1) // 2)
    ahead, rows = depth - back, edges.count()
    edges = edges.select("src", "dst", "kind", "confidence").filter("src != dst")
    pairs = _stored(ends.select("seed", "target").distinct(), f"{place}/pairs")
    targets = _stored(pairs.select("target").distinct(), f"{place}/near/hops=0")
    tails = _tails(edges, targets, back, limit + 1 + ahead, rows, place, name)
    near = _near(edges, targets, (depth - 1) // 2, place) if ahead > 2 else []
    now, ended, lost = pairs.select("seed", "target", F.col("seed").alias("node"), F.lit(1.0).alias("weakest")), [], []
    for d in range(1, ahead + 1):
        trail, left = [f"n{i}" for i in range(1, d)] + [f"k{i}" for i in range(1, d)], depth - d
        if left < len(near):
            out = edges.join(bounded(near[left]), "dst").withColumnRenamed("src", "node")
            step = now.join(out, ["node", "target"])
        else:
            out = within(edges, "src", now.select("node")).withColumnRenamed("src", "node")
            step = spread(now, rows, "node").join(spread(out, rows, "node"), "node")
        step = step.filter(~F.col("dst").isin(*[F.col(c) for c in ("seed", *trail[: d - 1])]))
        by = ["seed", "target", *trail, F.col("dst").alias(f"n{d}"), F.col("kind").alias(f"k{d}")]
        now = step.groupBy(*by).agg(F.max(F.least("weakest", "confidence")).alias("weakest")).withColumn("node", F.col(f"n{d}"))
        if d > 1 or _crowded(edges, pairs, beam):
            nodes, kinds = [name(F.col(f"n{i}")) for i in range(1, d + 1)], [F.col(f"k{i}") for i in range(1, d + 1)]
            now = top(now, beam + 1, ["seed", "target"], F.col("weakest").desc(), *nodes, *kinds, rank="at").withColumn("cut", F.col("at") > beam).drop("at")
            now = _stored(now, f"{place}/hops/hop={d}")
            lost.append(now.filter("cut").select("seed", "target"))
            now = now.filter("NOT cut").drop("cut")
        if d < ahead:
            ended.append(now.filter("node = target").withColumn("hops", F.lit(d)))
    found = spread(now, rows, "node", "target").join(tails, ["node", "target"])
    for x in ["seed", *[f"n{i}" for i in range(1, ahead)]]:
        found = found.filter(F.col("m").isNull() | (F.col("m") != F.col(x)))
    for x in ["seed", *[f"n{i}" for i in range(1, ahead + 1)]]:
        found = found.filter((F.col("target") != F.col(x)) | (F.lit(x == f"n{ahead}") & (F.col("hops") == 0)))
    nodes = [*[f"n{i}" for i in range(1, ahead + 1)], "m"]
    kinds = [*[f"k{i}" for i in range(1, ahead + 1)], "j1", "j2"]
    found = found.withColumn("weakest", F.least("weakest", "sure")).withColumn("hops", F.col("hops") + ahead).select("seed", "target", *nodes, *kinds, "weakest", "hops")
    for e in ended:
        found = found.unionByName(e.drop("node"), allowMissingColumns=True)
    found = found.withColumn("lost", F.lit(False))
    if lost:
        found = found.unionByName(reduce(DataFrame.union, lost).distinct().withColumn("lost", F.lit(True)), allowMissingColumns=True)
    found = spread(found, rows, "seed", "target")
    pair = Window.partitionBy("seed", "target")
    # a mark of lost paths takes the row after the last that is told: it comes first, and one row more is kept
    order = [F.col("lost").desc(), "hops", F.col("weakest").desc(), *[name(F.col(n)) for n in nodes], *kinds]
    best = top(found, limit + 2, ["seed", "target"], *order, rank="at").withColumn("marks", F.max(F.col("lost").cast("int")).over(pair))
    best = best.withColumn("truncated", (F.col("marks") > 0) | (F.max("at").over(pair) > limit)).filter(f"NOT lost AND at - marks <= {limit}")
    best = _stored(best.select("seed", "target", *nodes, *kinds, "hops", "weakest", "truncated"), f"{place}/hops/hop={ahead + 1}")
    last = F.when(F.col("hops") > ahead, F.col("target"))
    path = F.filter(F.array("seed", *nodes, last), lambda n: n.isNotNull())
    return best.select("seed", "target", path.alias("path"), F.slice(F.array(*kinds), 1, F.col("hops")).alias("kinds"), "weakest", "truncated")


def _crowded(edges: DataFrame, pairs: DataFrame, beam: int) -> bool:
    """Whether any node in the seeds' range has more edges than the beam: if none has, no pair loses anything at the first hop."""
    most = within(edges, "src", pairs.select("seed")).groupBy("src").count().agg(F.max("count")).first()[0]
    return (most or 0) > beam


def _tails(edges: DataFrame, targets: DataFrame, hops: int, keep: int, rows: int, place: str, name: Callable[[Column], Column]) -> DataFrame:
    """(node, target, m, j1, j2, sure, hops): the last hops to a target, none to `hops` (1 or 2), by the node m between and the kinds.

    Of equally sure and long ones of a node and target those by the first `keep` nodes m are given: the others come after them in
    whatever path, of whose nodes up to `keep` less limit + 1 may be a node m.
    """
    kind, id_ = edges.schema["kind"].dataType, edges.schema["dst"].dataType
    none = [F.lit(None).cast(id_).alias("m"), F.lit(None).cast(kind).alias("j1"), F.lit(None).cast(kind).alias("j2")]
    at = targets.select(F.col("target").alias("node"), "target", *none, F.lit(float("inf")).alias("sure"), F.lit(0).alias("hops"))
    there = sifted(edges, "dst", targets).join(bounded(targets), F.col("dst") == F.col("target"))
    one = _stored(there.groupBy(F.col("src").alias("node"), "target", F.col("kind").alias("j1")).agg(F.max("confidence").alias("sure")), f"{place}/near/hops=1")
    every = at.unionByName(one.select("node", "target", none[0], "j1", none[2], "sure", F.lit(1).alias("hops")))
    if hops > 1:
        near = one.select(F.col("node").alias("dst"), "target", F.col("j1").alias("j2"), "sure")
        two = sifted(edges, "dst", one.select("node")).join(bounded(near), "dst").filter("src != target")
        every = every.unionByName(two.select(F.col("src").alias("node"), "target", F.col("dst").alias("m"), F.col("kind").alias("j1"), "j2", F.least("sure", "confidence").alias("sure"), F.lit(2).alias("hops")))
    every = spread(every, rows, "node", "target").groupBy("node", "target", "m", "j1", "j2", "hops").agg(F.max("sure").alias("sure"))
    alike = Window.partitionBy("node", "target", "sure", "hops").orderBy(name(F.col("m")))
    return every.withColumn("at", F.dense_rank().over(alike)).filter(F.col("at") <= keep).drop("at")


def _near(edges: DataFrame, targets: DataFrame, hops: int, place: str) -> list[DataFrame]:
    """(dst, target) by the number of hops within which a node reaches a target, from none to `hops`; stored, as each is read often."""
    near = [targets.select(F.col("target").alias("dst"), "target")]
    for h in range(1, hops + 1):
        back = edges.join(bounded(near[-1]), "dst").select(F.col("src").alias("dst"), "target")
        near.append(_stored(near[-1].union(back).distinct(), f"{place}/reach/hops={h}"))
    return near
