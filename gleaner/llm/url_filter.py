"""URL rules: a blocked Bloom filter of listed (host, path) keys, then an exact hash join.

Every URL offers the keys made of a suffix of its host (at label borders) and a prefix of its path (of a length that
some listed path has). The filter drops nearly all keys of URLs that are not listed; the survivors are joined with
the list itself, which removes false positives; of the rules that fit, the longest decides.

Defined cases: a null url or one without `://` has an empty host and path and fits no rule; a URL that fits no rule
is allowed (the list names no more); equal rules count once, a block before an allow; of two fitting rules of one
length, that with the longer host decides; repeated rows are judged alike; very long urls are judged whole; an empty
list allows everything; an empty table of pages gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.shared import bounded

#: A block is eight words of 64 bits: one cache line; a key sets one bit in each word.
WORDS = 8
#: Bits of filter for each key: about 0.3 % false positives.
BITS_PER_KEY = 16
#: Keys up to which the filter is a literal of the plan; beyond, its blocks are a broadcast table, of so many at most (8 MB).
LITERAL_KEYS, MAX_BLOCKS = 2_000, 1 << 17
#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "host string, path string, verdict string")


def _bits(h: Column, word: int) -> Column:
    """The bit that a key sets in one word of its block: six bits of a second hash."""
    return F.shiftrightunsigned(h, 6 * word).bitwiseAND(F.lit(63)).cast("int")


class BlockedBloom:
    """Filter words in an array literal; tested by built-in expressions only."""

    def __init__(self, hashes: np.ndarray):
        """hashes: rows of (block hash, bit hash) of each key."""
        self.blocks = max(1, -(-len(hashes) * BITS_PER_KEY // (64 * WORDS)))
        self.words = np.zeros(self.blocks * WORDS, dtype=np.int64)
        for place, bits in hashes.tolist():
            block = place % self.blocks
            for w in range(WORDS):
                bit = np.uint64(1) << np.uint64(((bits & ((1 << 64) - 1)) >> (6 * w)) & 63)
                self.words.view(np.uint64)[block * WORDS + w] |= bit

    def hit(self, place: Column, bits: Column) -> Column:
        words = F.lit(self.words.tolist()) if self.blocks > 1 else F.array(*map(F.lit, self.words.tolist()))
        at = (F.pmod(place, F.lit(self.blocks)) * WORDS).cast("int")
        hit = F.lit(True)
        for w in range(WORDS):
            hit = hit & (F.expr("1L") == F.call_function("shiftrightunsigned", F.get(words, at + w), _bits(bits, w)).bitwiseAND(F.expr("1L")))
        return hit


def block_table(listed: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The filter as a table: one row a block with its eight words, set by aggregates alone; and the number of blocks."""
    blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_PER_KEY // (64 * WORDS))))
    keyed = listed.select(F.pmod(F.xxhash64("k"), F.lit(blocks)).alias("block"), F.xxhash64("k", F.lit(1)).alias("b"))
    words = [F.bit_or(F.call_function("shiftleft", F.expr("1L"), _bits(F.col("b"), w))).alias(f"w{w}") for w in range(WORDS)]
    return keyed.groupBy("block").agg(*words), blocks


def in_table(keys: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """The keys (column k) that pass the filter."""
    marked = keys.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks))).join(F.broadcast(table), "block")
    for w in range(WORDS):
        bit = _bits(F.xxhash64("k", F.lit(1)), w)
        marked = marked.filter(F.call_function("shiftrightunsigned", F.col(f"w{w}"), bit).bitwiseAND(F.expr("1L")) == 1)
    return marked.select(*keys.columns)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), literal: int = LITERAL_KEYS) -> DataFrame:
    """`keep`, host, path, rule (host and path of the deciding rule, or null) and verdict, a row for each row.

    Of the list only its distinct path lengths and, up to `literal` keys, hashes reach the driver; the filter is bounded
    (MAX_BLOCKS), and the list itself is broadcast only below a counted bound.
    """
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    key = lambda h, p: F.concat_ws("\x00", h, p)
    listed = listed.select(key(F.col("host"), F.col("path")).alias("k"), "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    n = listed.count()
    url = F.col(url_col)
    base = pages.select(*keep, url.alias("__url"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not n:
        return base.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    labels = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    offered = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: key(h, p))))
    if n <= literal:
        hashes = listed.select(F.xxhash64("k"), F.xxhash64("k", F.lit(1))).collect()
        bloom = BlockedBloom(np.array(hashes, dtype=np.int64))
        offered = F.filter(offered, lambda k: bloom.hit(F.xxhash64(k), F.xxhash64(k, F.lit(1))))
    base = base.withColumn("__keys", offered)
    hits = base.filter(F.size("__keys") > 0).select("__url", F.explode("__keys").alias("k"))
    hits = (hits if n <= literal else in_table(hits, *block_table(listed, n))).distinct()
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "host_len"))
    decided = hits.join(bounded(listed, n), "k").groupBy("__url").agg(best.alias("__best"))
    return base.join(decided, "__url", "left").select(
        *keep, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit("allow")).alias("verdict")
    )


ORACLE = r"""
WITH rules(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
     ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT page_id, host, path, (SELECT max_by(struct_pack(rule := rh || rp, verdict := rv), length(rh || rp)) FROM rules
     WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM parts)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM fits
"""
