"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document of a source with target T and size S should be taken T/S times: `base` whole copies and a fraction. The
fractions, as words of mass (size times fraction), are rounded in pairs: a coin decides the direction, and mass moves
from one document to the other until one of the two has none or all of its words. A pair keeps its sum of words, so
a source keeps its target, and each document's chance to be taken up is its fraction. Pairs are made within blocks of
about BLOCK documents, largest document first; each block hands the document that is still open to the next level, until
BLOCK at most are left in a source. These meet one block of the source that was kept aside, and a coin of its fraction's
odds rounds the last document open there. What that adds or takes is made good by a few documents of that block: among
the subsets of a dozen, chosen by chance, one that brings the words near again, of few documents, is turned; as that is as
likely to add as to take, it leaves each document's chance near its fraction. No task sees more than two blocks.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 get no
words; equal sizes are paired in the order of a hash of the identifier; repeated rows are documents of their own; very
long texts count whole, and one longer than its source's target is taken if that comes nearest to the target; an empty table gives an empty
result; extra columns stay out of `decide` and pass through `apply_mix` untouched, whatever their names. Two windows see
one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import bounded, fresh, let, stored, unit

BLOCK = 128
#: Documents of which every subset is weighed to mend the last rounding, and the error allowed (a share of the block's words).
TURNED, NEAR = 12, 0.005
WEIGHTS, RATIO, CAP, SEED = (3, 1, 2), 1.5, 2.0, 20_240_601


def words(text: Column) -> Column:
    """Number of runs without white space (0x20, 0x09 to 0x0D)."""
    padded = F.regexp_replace(F.coalesce(text, F.lit("")), "[^ \\x09-\\x0D]+", "x")
    return (F.length(padded) - F.length(F.replace(padded, F.lit("x"), F.lit("")))).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """A row for each source: source, source_size, n, target.

    The shared total is filled by weight; a source stops at `cap` times its size. With sources in order of the level
    at which each stops (cap times size over weight), the level that holds for the rest follows from running sums.
    These windows see one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))
    everything = Window.partitionBy()
    per = per.withColumns({"w": weight, "limit": F.col("source_size") * cap}).withColumns(
        {"stop": F.col("limit") / F.col("w"), "total": F.sum("source_size").over(everything) * ratio}
    )
    order = Window.orderBy("stop", F.col("source").asc_nulls_last())
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / F.sum("w").over(later))
    level = F.max("level").over(everything)  # it rises up to the first source that doesn't stop, then falls
    return per.withColumn("all", level).select(
        "source", "source_size", "n", F.when(F.col("stop") <= F.col("all"), F.col("limit")).otherwise(F.col("w") * F.col("all")).alias("target")
    )


def _rounded(level: int, seed: int) -> Column:
    """Fold a sorted array `u` of units into struct(act: the unit still open, done: those decided)."""

    def settle(acc: Column, b: Column) -> Column:
        a = acc["act"]
        a_gap, b_gap = a["size"] - a["mass"], b["size"] - b["mass"]
        up, down = F.least(a_gap, b["mass"]), F.least(a["mass"], b_gap)
        rises = unit(a["id"], a["occ"], b["id"], b["occ"], F.lit(seed + level)) * (up + down) < down
        case = F.when(rises, F.when(a_gap <= b["mass"], 0).otherwise(1)).otherwise(F.when(a["mass"] <= b_gap, 2).otherwise(3))

        def move(k: Column) -> Column:
            a_leaves = k.isin(0, 2)
            out = F.when(a_leaves, _unit(a, a["mass"])).otherwise(_unit(b, b["mass"]))
            stays = F.when(a_leaves, _unit(b, F.when(k == 0, b["mass"] - a_gap).otherwise(b["mass"] + a["mass"]))).otherwise(
                _unit(a, F.when(k == 1, a["mass"] + b["mass"]).otherwise(a["mass"] - b_gap))
            )
            return F.struct(stays.alias("act"), F.concat(acc["done"], F.array(_decided(out, k.isin(0, 3)))).alias("done"))

        return let(case, move)

    u = F.col("u")
    none = F.filter(F.array(_decided(u[0], F.lit(False))), lambda x: F.lit(False))
    return F.aggregate(F.slice(u, 2, F.size(u)), F.struct(_unit(u[0], u[0]["mass"]).alias("act"), none.alias("done")), settle)


def _unit(x: Column, mass: Column) -> Column:
    return F.struct(x["id"].alias("id"), x["occ"].alias("occ"), x["size"].alias("size"), x["base"].alias("base"), mass.alias("mass"))


def _decided(x: Column, taken: Column) -> Column:
    return F.struct(x["id"].alias("id"), x["occ"].alias("occ"), x["size"].alias("size"), x["base"].alias("base"), taken.alias("more"))


def _closed(r: Column, seed: int) -> Column:
    """All units of the last block, decided: a coin rounds the open one, and if that leaves an error of words, few others are turned.

    Of TURNED units (the open one and others in random order) every subset is weighed: any that brings the error within
    NEAR of the block's words will do, the smallest first and by chance among those; if none does, the one of least error.
    """
    act = r["act"]
    up = (act["mass"] > 0) & (unit(act["id"], act["occ"], act["size"], F.lit(seed)) * act["size"] < act["mass"])
    error = F.when(up, act["size"] - act["mass"]).otherwise(-act["mass"]).cast("double")
    dealt = F.transform(F.array_sort(F.transform(r["done"], lambda d: F.struct(F.xxhash64(d["id"], d["occ"], d["size"], F.lit(seed + 1)).alias("h"), d.alias("d")))), lambda x: x["d"])
    every = F.concat(F.array(_decided(act, up)), dealt)
    words = F.aggregate(every, F.lit(0.0), lambda acc, d: acc + d["size"])
    parts = F.struct(F.filter(every, lambda d: d["size"] > 0).alias("some"), F.filter(every, lambda d: d["size"] <= 0).alias("none"), error.alias("error"), (NEAR * words + 1).alias("near"))

    def mended(p: Column) -> Column:
        few = F.slice(p["some"], 1, TURNED)
        step = lambda d: F.when(d["more"], -d["size"]).otherwise(d["size"]).cast("double")
        start = F.array(F.struct(p["error"].alias("error"), F.lit(0).alias("turned"), F.lit(0).alias("mask")))
        both = lambda acc, x: F.concat(acc, F.transform(acc, lambda y: F.struct((y["error"] + x["step"]).alias("error"), (y["turned"] + 1).alias("turned"), y["mask"].bitwiseOR(x["bit"]).alias("mask"))))
        steps = F.transform(few, lambda d, i: F.struct(step(d).alias("step"), F.call_function("shiftleft", F.lit(1), i).alias("bit")))
        chance = lambda y: F.xxhash64(act["id"], act["occ"], y["mask"], F.lit(seed + 2))
        key = lambda y: F.struct(F.when(F.abs(y["error"]) <= p["near"], y["turned"].cast("double")).otherwise(TURNED + F.abs(y["error"])).alias("cost"), chance(y).alias("h"), y["mask"].alias("mask"))
        best = F.array_min(F.transform(F.aggregate(steps, start, both), key))["mask"]
        mask = F.when(F.abs(p["error"]) <= p["near"], F.lit(0)).otherwise(best)
        is_in = lambda m, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1
        turn = lambda m: F.transform(few, lambda d, i: _decided(d, d["more"] != is_in(m, i)))
        return F.concat(let(mask, turn), F.slice(p["some"], TURNED + 1, F.size(p["some"]) + 1), p["none"])

    return let(parts, mended)


def decide(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, ratio=RATIO, cap=CAP, block=BLOCK, seed=SEED) -> DataFrame:
    """id, occ (1.. among rows of equal id, source and size), source, size, source_size, target, copies: a row a document.

    The text is read once; then only ids and sizes move. Rows of equal id, source and size are counted before the
    shuffle and numbered after it, so that they spread over blocks like all others.
    """
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "mix-sizes")
    aims = stored(targets(sized, weights, ratio, cap), "mix-targets")
    n_sources, most = aims.agg(F.count("*"), F.max("n")).first()
    aims = bounded(aims, n_sources)
    units = sized.groupBy("id", "source", "size").agg(F.count("*").alias("m"))
    units = units.select("id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("occ"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    units = units.join(aims, units["source"].eqNullSafe(aims["source"])).select(
        units["source"], "id", "occ", "size", F.floor(rate).cast("int").alias("base"), (F.col("size") * (rate - F.floor(rate))).alias("mass"), F.ceil(F.col("n") / block).alias("blocks")
    )

    def folded(units: DataFrame, level: int, *by) -> DataFrame:
        unit_of = F.struct((-F.col("size")).alias("order"), F.xxhash64("id", "occ", F.lit(seed)).alias("h"), *(F.col(c) for c in ("id", "occ", "size", "base", "mass")))
        grouped = units.groupBy("source", *by).agg(F.array_sort(F.collect_list(unit_of)).alias("u"))
        return grouped.select("source", *[c for c in ("blocks",) if by], _rounded(level, seed).alias("r"))

    kept, level, aside = [], 0, units.limit(0)
    while most and most > block:
        block_of = F.pmod(F.xxhash64("id", "occ", F.lit(seed + level)), F.col("blocks"))
        if level == 0:
            aside, units = units.filter(block_of == 0), units.filter(block_of > 0)
        step = stored(folded(units, level, "blocks", block_of.alias("block")), f"mix-level{level}")
        kept.append(step.select("source", F.explode("r.done").alias("d")))
        units = step.select("source", "r.act.*", F.ceil(F.col("blocks") / block).alias("blocks"))
        most, level = -(-most // block), level + 1
    last = folded(units.unionByName(aside) if level else units, level)
    kept.append(last.select("source", F.explode(let(F.col("r"), lambda r: _closed(r, seed))).alias("d")))
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    out = out.select("source", "d.*").withColumn("copies", F.col("base") + F.col("more").cast("int"))
    return out.join(aims, out["source"].eqNullSafe(aims["source"])).select("id", "occ", out["source"], "size", "source_size", "target", "copies")


def taken(decisions: DataFrame, id_col="doc_id") -> DataFrame:
    return decisions.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(docs: DataFrame, decisions: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The documents, each as often as the mix takes it (0, 1 or 2 times); columns as in `docs`.

    Rows that share id, source and size are told apart by a running number, made for those rows only.
    """
    size, number, times = fresh(docs, "__size", "__number", "__times")
    most = decisions.agg(F.max("copies")).first()[0] or 0
    each = [F.count(F.when(F.col("copies") == n, 1)).alias(f"n{n}") for n in range(most + 1)]
    counts = decisions.groupBy("id", "source", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("sum"), F.array(*each).alias("with"))
    counts = counts.hint("merge").alias("k")  # a row a document: the plan of large tables, at every size
    sized = docs.withColumn(size, words(F.col(text_col))).alias("d")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("k.id")) & F.col(f"d.{source_col}").eqNullSafe(F.col("k.source")) & (F.col(f"d.{size}") == F.col("k.size"))
    plain, own = [F.col(f"`{c}`") for c in docs.columns], [F.col(f"d.`{c}`") for c in docs.columns]
    known = sized.join(counts, same)
    once = known.filter("k.n = 1").select(*own, F.col("k.sum").cast("int").alias(times))
    place = F.row_number().over(Window.partitionBy(f"d.{id_col}", f"d.{source_col}", f"d.{size}").orderBy(F.xxhash64(f"d.{text_col}")))
    again = known.filter("k.n > 1").select(*own, place.alias(number), F.col("k.with").alias(times))
    up_to = F.lit(0)  # the first rows are taken most often
    for n in range(1, most + 1):
        up_to = F.when(F.col(number) <= sum((F.get(times, F.lit(m)) for m in range(n, most + 1)), F.lit(0)), n).otherwise(up_to)
    both = once.unionByName(again.select(*plain, up_to.cast("int").alias(times)))
    return both.filter(F.col(times) > 0).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*plain)
