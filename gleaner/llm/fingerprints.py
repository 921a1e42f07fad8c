"""Document fingerprints by order MinHash, in DataFrame operations only.

A text's words give k-mers, each numbered by how often it has occurred before, so that repeats are distinct. The hash
of a numbered k-mer names its bucket; in each bucket the PICKED smallest hashes are selected, put in text order and
hashed together. A match of two texts in a bucket so asks for the same k-mers in the same order, which is what makes
the share of matching buckets follow edit distance rather than overlap alone. One hash function with buckets stands
for as many functions as there are buckets, so the work is that of sorting a text's k-mers twice.

K-mer hashes and places are packed in one 64-bit number (33 bits of hash, 31 of place, as many as an array can have), so
both sorts are of plain numbers. Each text is handled within its row: no explode and no shuffle for the fingerprints
themselves.

Defined cases: null text counts as empty; an empty text, or one of white space, has the empty fingerprint, and two
such are alike by 1; a text of fewer than K words is one k-mer; a run of over WORD code points without white space gives
a word for each window of WINDOW code points, so that an insertion changes a few of them only; very long texts are read
whole; equal hashes count as repeats of a k-mer; texts alike have equal fingerprints; rows of one identifier are ordered
by a hash of their text; null identifiers come last; one row is its own next; an empty table gives an empty result;
extra columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, BUCKET_BITS, WORD, WINDOW = 2, 6, 32, 8
#: Rows of an identifier range in the neighbour step; ranges at most (beyond 100 million rows they grow: each is a sort
#: that may spill); identifiers sampled for each range to place its ends.
RANGE_ROWS, RANGES, SAMPLED = 1000, 100_000, 20
_PLACE = (1 << 31) - 1


def _hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_PLACE))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE))


def _indices(a: str) -> Column:
    """0 to size - 1 of an array column (empty for an empty one)."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _words(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    runs = F.regexp_extract_all(text, F.lit("[^ \\x09-\\x0D]+"), F.lit(0))
    windows = lambda run: F.transform(F.regexp_extract_all(run, F.lit(f"(?s)(?=(.{{{WINDOW}}}))"), F.lit(1)), lambda x: F.xxhash64(x))
    cut = F.flatten(F.transform(runs, lambda run: F.when(F.length(run) > WORD, windows(run)).otherwise(F.array(F.xxhash64(run)))))
    return F.when(text.rlike(f"[^ \\x09-\\x0D]{{{WORD + 1}}}"), cut).otherwise(F.transform(runs, lambda x: F.xxhash64(x)))


def fingerprinted(df: DataFrame, text_col: str, out: str, k: int = K, bits: int = BUCKET_BITS) -> DataFrame:
    """`df` and a column `out`: array<long>, for each bucket that has k-mers its number (high bits) and tuple hash (32 bits).

    Each step is a projection of its own, so that arrays are made once and the sorts run on primitive arrays.
    """
    kept = df.columns

    def step(d: DataFrame, **new: Column) -> DataFrame:
        return d.select(*kept, *[v.alias(n) for n, v in new.items()])

    d = step(df, w=_words(F.coalesce(text_col, F.lit(""))))
    packed = lambda h, i: _hash(h).bitwiseOR(_place(i.cast("long")))
    several = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: packed(F.xxhash64(*[F.get("w", i + j) for j in range(k)]), i))
    d = step(d, s=F.array_sort(F.when(F.size("w") >= k, several).when(F.size("w") > 0, F.array(packed(F.xxhash64("w"), F.lit(0)))).otherwise(F.expr("cast(array() as array<bigint>)"))))
    first = F.filter(_indices("s"), lambda i: (i == 0) | (_hash(F.get("s", i)) != _hash(F.get("s", F.greatest(i - 1, F.lit(0))))))
    d = step(d, s=F.col("s"), starts=first)
    numbered = lambda x, o: packed(F.xxhash64(_hash(x), o.cast("int")), _place(x))
    end = lambda r: F.coalesce(F.get("starts", r + 1), F.size("s"))
    runs = F.filter(_indices("starts"), lambda r: end(r) - F.get("starts", r) > 1)
    again = F.flatten(F.transform(runs, lambda r: F.transform(F.slice("s", F.get("starts", r) + 2, end(r) - F.get("starts", r) - 1), lambda x, o: numbered(x, o + 1))))
    firsts = F.transform("starts", lambda i: numbered(F.get("s", i), F.lit(0)))
    d = step(d, e=F.array_sort(F.when(F.size("starts") == F.size("s"), firsts).otherwise(F.concat(firsts, again))))
    bucket = lambda x: F.shiftrightunsigned(x, 64 - bits)
    tops = F.filter(_indices("e"), lambda i: (i == 0) | (bucket(F.get("e", i)) != bucket(F.get("e", F.greatest(i - 1, F.lit(0))))))
    d = step(d, e=F.col("e"), tops=tops)

    def picked(i: Column) -> Column:
        a, b = F.get("e", i), F.get("e", i + 1)
        pair = b.isNotNull() & (bucket(a) == bucket(b))
        both = F.when(_place(a) <= _place(b), F.xxhash64(_hash(a), _hash(b))).otherwise(F.xxhash64(_hash(b), _hash(a)))
        low = F.when(pair, both).otherwise(F.xxhash64(_hash(a))).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(bucket(a), 32).bitwiseOR(low)

    return d.select(*kept, F.transform("tops", picked).alias(out))


def text_of(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of matching tuples among the buckets that either text fills; 1 for two empty texts."""
    filled = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _above(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are greater than a value: looked for in groups of them, then in one group."""
    if not cuts:
        return F.lit(0)
    size = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    lasts, all_ = F.array(*[F.lit(g[-1]) for g in groups]), F.array(*[F.array(*map(F.lit, g)) for g in groups])
    at = F.size(F.filter(lasts, lambda c: c <= value))  # whole groups that aren't greater
    below = at * size + F.coalesce(F.size(F.filter(F.get(all_, at), lambda c: c <= value)), F.lit(0))
    return F.when(at >= len(groups), 0).otherwise(len(cuts) - below)


def with_next(df: DataFrame, id_col: str, text_col: str, carried: tuple[str, ...], prepare=lambda d: d, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each row and, as next_*, `carried` of the following row in order of descending identifier (after the last: the first).

    The order is cut into ranges at quantiles of a sample of the identifiers, chosen by their hash. Every range is sorted
    by itself and also gets a copy of the first row of the following range, so one shuffle is enough and no task sees
    more than a range. `prepare` adds columns before the shuffle; it is applied once to each row and to the copies, which
    are one a range.
    """
    n = df.count()
    ranges = max(1, min(RANGES, -(-n // range_rows)))
    cuts = []
    if ranges > 1:  # about SAMPLED * ranges identifiers, 2 * SAMPLED * RANGES at most, come to the driver
        ids = df.filter(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(max(1, n // (SAMPLED * ranges)))) == 0)).select(id_col)
        found = sorted(r[0] for r in ids.distinct().collect())
        cuts = sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []
    place = _above(F.col(id_col), cuts)
    order = F.xxhash64(text_col)
    rows = df.withColumn("__range", F.when(F.col(id_col).isNull(), F.lit(len(cuts) + 1)).otherwise(place)).withColumn("__h", order)
    # ids only: where each range begins, and which range stands before it
    heads = rows.groupBy("__range").agg(F.max(id_col).alias("__head"))
    all_ranges = Window.orderBy("__range")  # one row a range
    last = F.max("__range").over(Window.partitionBy())
    heads = F.broadcast(heads.select("__range", "__head", F.coalesce(F.lag("__range").over(all_ranges), last).alias("__to")))
    first = rows.alias("r").join(heads.alias("h"), (F.col("r.__range") == F.col("h.__range")) & F.col(f"r.{id_col}").eqNullSafe(F.col("h.__head")))
    ghosts = first.groupBy("__to").agg(F.min_by(F.struct(*[F.col(f"r.{c}").alias(c) for c in df.columns]), F.col("r.__h")).alias("g"))
    ghosts = ghosts.select("g.*", F.col("__to").alias("__range"), F.lit(0).cast("long").alias("__h"), F.lit(1).alias("__ghost"))
    both = prepare(rows.withColumn("__ghost", F.lit(0))).unionByName(prepare(ghosts))
    follows = Window.partitionBy("__range").orderBy("__ghost", F.col(id_col).desc_nulls_last(), "__h")
    out = both.select("*", *[F.lead(c).over(follows).alias(f"next_{c}") for c in carried])
    return out.filter(F.col("__ghost") == 0).drop("__ghost", "__range", "__h")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited text, and signatures of text, edited text and next text."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = with_next(base, "id", "t", ("t", "sig"), lambda d: fingerprinted(d, "t", "sig"))
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - half), F.substring("next_t", F.lit(1), half))
    base = base.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sig", "next_sig")
    return fingerprinted(base, "edited", "edited_sig")


def report(compared: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return compared.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("sig")).alias("fingerprint"), text_of(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).cast("double").alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).cast("double").alias("near_next"),
    )
