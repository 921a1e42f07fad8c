"""Periodic runs of words in a text, found where a repeated k-gram allows them.

A run is a stretch of words with smallest period q that holds `exponent` periods and `least` words at least, and that
no neighbouring word extends keeping the period. A run of length L equals itself shifted by q in L - q words, so that
many words, at least k = the minimum of max(least, exponent * q) - q over q, occur twice in the document, and every word of
the run is in such a k-gram. So k-grams are hashed (equal ones always get equal hashes, so a clash can only keep
words) and words that no repeated one covers are masked: no run holds or crosses them. What survives are segments, in most
documents none; each is searched by Main and Lorentz: halves first, then all repetitions over the middle, from the
longest common extensions that Z functions give for every period at once. A repetition that could go on beyond its block is left
to the block where it ends, so each run is found whole.

A document is one row of one task: time grows with its surviving words times their logarithm, memory with its words.

Defined cases: null counts as empty text and has no runs; texts of fewer than `least` words have none; whole texts are
read, however long; runs that overlap or touch are all given; equal texts give equal runs; repeated rows and null
identifiers are rows of their own; an empty table gives an empty result; other columns pass if named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.shared import fresh

LEAST, EXPONENT = 24, 3
#: Characters of text in one output batch.
BATCH_BYTES = 8 << 20


def overlap(least: int, exponent: int) -> int:
    """Words that every run shares with itself shifted by its period, at least."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def mask(ids: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that occurs twice; unlike ones may be taken for equal, but not equal ones for unlike."""
    n = len(ids)
    out = np.zeros(n, bool)
    if n <= k:
        return out
    with np.errstate(over="ignore"):
        grams, width = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
        for bit in bin(k)[3:]:  # the binary digits of k after the first: double, then add one word
            base = np.uint64(pow(0xD1342543DE82EF95, width, 1 << 64))
            grams, width = grams[:-width] * base + grams[width:], 2 * width
            if bit == "1":
                tail = (ids[width:].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                grams, width = grams[: len(tail)] * np.uint64(0xD1342543DE82EF95) + tail, width + 1
        grams ^= grams >> np.uint64(29)
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return out
    again = np.zeros(len(grams) + k, np.int64)
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    np.add.at(again, starts, 1)
    np.subtract.at(again, starts + k, 1)
    return np.cumsum(again)[:n] > 0


def _z(s: list) -> list:
    """Length of the longest common prefix of s and each of its suffixes."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def runs(w: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a segment, by start and period."""
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(w))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        mid, most = (lo + hi) // 2, (hi - lo) // exponent
        todo += [(lo, mid), (mid, hi)]
        u, v = w[lo:mid], w[mid:hi]
        back, gap = u[::-1], [-1]
        ahead_v, behind_u = _z(v), _z(back)
        ahead_vu = _z(v + gap + u)[len(v) + 1 :]  # from each place of u on, agreement with v
        behind_uv = _z(back + gap + v[::-1])[len(u) + 1 :]  # from each place of v back, agreement with u
        for p in range(1, most + 1):
            on_right, on_left = ahead_v[p] if p < len(v) else 0, behind_u[p] if p < len(u) else 0
            spans = []
            if p <= len(v):  # mid is compared with mid + p, mid - 1 with mid + p - 1; past a whole period u is compared with itself
                left = behind_uv[len(v) - p]
                spans.append((mid - (left if left < p else p + on_left), mid + p + on_right))
            if p <= len(u):
                right = ahead_vu[len(u) - p]
                spans.append((mid - p - on_left, mid + (right if right < p else p + on_right)))
            for start, end in spans:
                if end - start < max(least, exponent * p) or (start == lo and lo and w[lo - 1] == w[lo - 1 + p]) or (end == hi and hi < len(w) and w[hi] == w[hi - p]):
                    continue
                if p < found.get((start, end), p + 1):
                    found[start, end] = p
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _segments(alive: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], alive.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def in_words(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs of a list of words."""
    if len(words) < least:
        return []
    number = {x: i for i, x in enumerate(dict.fromkeys(words))}
    if len(words) - len(number) < overlap(least, exponent):  # too few words occur again for any run
        return []
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    out = []
    for lo, hi in _segments(mask(ids, overlap(least, exponent))):
        out += [(lo + s, n, p) for s, n, p in runs(ids[lo:hi].tolist(), least, exponent)]
    return out


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in found:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep`, runs array<struct<start,length,period>>, text: the words that stay, joined by one space. One pass, no shuffle."""
    own = [id_col, *keep]
    body, held = fresh(docs.select(*own), "__text", "runs")
    rest = fresh(docs.select(*own), "text")[0]
    plain = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(body))
    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType([*docs.select(*own).schema.fields, T.StructField(held, T.ArrayType(run, False)), T.StructField(rest, T.BinaryType())])
    kind = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(own))
            first, got, out, size = 0, [], [], 0
            for k in range(batch.num_rows):
                words = texts[k].as_py().split()  # of bytes: white space is 0x20 and 0x09 to 0x0D
                found = in_words(words, least, exponent)
                got.append(found)
                out.append(b" ".join(collapsed(words, found)))
                size += len(out[-1])
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    flat = np.array([r for f in got for r in f], np.int64).reshape(-1, 3)
                    structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind))
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]).astype(np.int32)), structs)
                    part = [batch.column(c).slice(first, k + 1 - first) for c in range(len(own))]
                    yield pa.RecordBatch.from_arrays([*part, lists, pa.array(out, pa.binary())], schema.names)
                    first, got, out, size = k + 1, [], [], 0

    return plain.mapInArrow(work, schema).withColumn(rest, F.col(rest).cast("string"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the run of greatest exponent, and digests of all runs and of the text that stays."""
    r = F.col("runs")
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), F.get(r, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))
    line = lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))
    rows = found.select(id_col, "text", "runs", best.alias("best"))
    return rows.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def with_periodic_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, a tenth of them (by crc32 of the identifier) with a tail that repeats its first words."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    w, h_, g, n, a, p = fresh(docs, "__w", "__h", "__g", "__n", "__a", "__p")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    split = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \\x09-\\x0D]+"), lambda x: x != "")
    wide = docs.withColumn(h_, h).withColumn(w, F.when(chosen, split)).withColumn(g, F.floor(F.col(h_) / 10)).withColumn(n, F.size(w).cast("long"))
    wide = wide.withColumn(a, F.when(F.col(n) > 0, F.col(g) % F.col(n))).withColumn(p, F.when(F.col(n) > 0, 1 + F.floor((F.col(n) - F.col(a)) / (3 + F.col(g) % 8))))
    turned = F.transform(F.col(w), lambda x, i: F.when(i < F.col(a), x).otherwise(F.get(F.col(w), (F.col(a) + (i - F.col(a)) % F.col(p)).cast("int"))))
    text = F.when(F.col(n) > 0, F.array_join(turned, " ")).otherwise(F.col(text_col))
    return wide.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])

