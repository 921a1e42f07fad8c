"""N-gram Jaccard self-join of documents by chosen paths.

A document is the set of hashes of its five-word shingles; documents of one set are one class. RUNS hash functions each
choose one token of a class (the token of least hash, so two sets choose alike with a probability equal to their
similarity). Each run begins a path with the token of its own function; classes that chose one token share a node.
A node of over SPLIT classes is split by the tokens of CHILDREN further functions: of those not yet on its path, the ones
on which its classes agree least (counted over the whole node), so that a token that most of them share doesn't keep
them together. Its parts are split again until LIMIT classes are left: unlike classes part quickly, as the chance of a common path
falls with each step, while a pair at 0.8 has 1.6 common parts to expect from each. A node whose classes are alike, by
their mean agreement over all functions, isn't split. Nodes of one class are dropped, nodes of LIMIT classes at most
are compared by brute force, and larger ones in pairs of blocks of that size, so that nothing is capped.

Two classes are compared at one of the nodes they share, and only if the functions agree on NEED of their tokens or
more (a sketch made of the keys themselves); the comparison itself is exact, on the whole sets. `runs_and_need` repeats runs until a pair
of the similarity asked for is lost with a chance below LOSS, by having too few hits (16 runs and 4 hits at 0.8: 2.5e-7).
Where nodes are split that chance grows with the steps, as some paths end: simulated at exactly 0.8, a pair is lost with
a chance of 3e-4 if all its nodes are split 3 times, of 0.7 % at 6 and of 9 % at 10 times (nodes of over 2 million texts
that share half of their shingles); at 0.9 the chance is below 1e-4 at 6 and 0.5 % at 10 times.

What moves: keys of classes, then sets of those that have a likely partner, once for each node in which a partner is
met. Their documents are picked by a Bloom filter of bounded size in a second scan, so no text is shuffled. Links are
counted where they are found and only sums leave a task, with edges to one member of each group of linked classes; pairs
are never written out.

Defined cases: null text counts as empty; empty texts are one class, linked to each other only; a text of fewer than
five words is one shingle; very long texts are read whole; repeated rows are documents of their class; equal hashes: a
class chooses one token all the same; null identifiers take part but name a class only if it has no other; an empty
table gives an empty result; extra columns stay out of `join`, and pass through `keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import connected, drop, fresh, look_up, parted, stored

WORDS, SIMILARITY, RUNS, LIMIT, SPLIT, LOSS = 5, 0.8, 16, 500, 2000, 2.5e-7
#: Functions that split a node; a node isn't split if two of its classes agree on this share of all functions on average.
CHILDREN, ALIKE = 2, 0.6
#: Words that a worker remembers the hash of; shingles hashed at once; pairs of a group compared one by one.
REMEMBERED, CHUNK, FEW = 200_000, 4096, 8
#: Rows of classes in large nodes whose tokens a task counts at once (16 MB of tokens).
HELD = 1 << 17
#: Power of two of the bits (8 MB) of the filter that picks the documents whose sets are read again.
MAX_BITS = 26
_POWERS = np.random.default_rng(20_240_817).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a lower-cased text."""
    found = (text or "").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(words, len(h))
    out = h[: len(h) - n + 1] * _POWERS[0]
    for j in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _POWERS[j] + h[j : len(h) - n + 1 + j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def runs_and_need(similarity: float) -> tuple[int, int]:
    """Runs (RUNS or more) and the most hits to ask for, two at least, that lose a pair of `similarity` with a chance below LOSS."""
    runs = RUNS
    while True:
        missed, need = 0.0, 0
        while need < runs and (missed := missed + comb(runs, need) * similarity**need * (1 - similarity) ** (runs - need)) <= LOSS:
            need += 1
        if need >= 2:
            return runs, need
        runs += 1


@lru_cache
def _functions(runs: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_818)
    drawn = rng.integers(0, 1 << 63, size=(runs, 2, 1), dtype=np.uint64)
    return drawn[:, 0], drawn[:, 1] * np.uint64(2) + np.uint64(1)


def chosen(tokens: np.ndarray, runs: int = RUNS) -> np.ndarray:
    """The token that each run chooses."""
    salts, odds = _functions(runs)
    parts = [((tokens[i : i + CHUNK] ^ salts) * odds).min(1) for i in range(0, len(tokens), CHUNK)]
    return np.minimum.reduce(parts).view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int, runs: int) -> DataFrame:
    """id, th (hash of the text), set (128-bit hash of the shingle set; 16 zero bytes if empty) and k1."""
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, firsts = [], []
            for text in batch.column(2):
                tokens = shingles(text.as_py(), words)
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else bytes(16))
                firsts.append(chosen(tokens, runs) if len(tokens) else np.empty(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, firsts)], dtype=np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(firsts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), lists], ["id", "th", "set", "k1"])
        _words.clear()  # an idle worker gives the memory back

    return plain.mapInArrow(work, f"id {plain.schema['id'].dataType.simpleString()}, th long, set binary, k1 array<long>")


def _nodes(classes: DataFrame, limit: int, split: int, runs: int) -> tuple[DataFrame, list[DataFrame]]:
    """set, n_docs, unit, run, leaf, block, within, path, leaves: a row for each node (or pair of its blocks) that a class shares,
    and the stored tables it reads.

    path: the first nodes of the class by run, 0 where it is alone, odd where the node is split. run: of a first node that isn't
    split, else -1; leaf: the split node's part, else 0, and leaves: all such parts of the class, in order.
    """
    keys = classes.filter(F.size("k1") > 0).select("set", "n_docs", F.posexplode("k1").alias("run", "k1"))
    shared = stored(keys.groupBy("run", "k1").agg(F.count("*").alias("n")).filter("n > 1"), "paths-first")
    members = keys.join(shared.hint("merge"), ["run", "k1"])  # it grows with the classes: the plan of large tables, at every size
    node = F.xxhash64("run", "k1").bitwiseAND(F.lit(-2)).bitwiseOR((F.col("n") > split).cast("long"))
    grouped = members.groupBy("set", "n_docs").agg(F.collect_list(F.struct("run", node.alias("node"), "n")).alias("at"))  # one for each run at most
    path = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.get(F.filter("at", lambda x: x["run"] == r), F.lit(0))["node"], F.lit(0)))
    rows = grouped.select("set", "n_docs", path.alias("path"), F.explode("at").alias("x")).select("set", "n_docs", "path", "x.*")
    none = F.expr("cast(array() as array<bigint>)")
    small = rows.filter(F.col("n") <= split).withColumns({"leaf": F.lit(0).cast("long"), "leaves": none})
    tables = [shared]
    if shared.filter(F.col("n") > split).limit(1).count():
        ends, tables = _leaves(rows.filter(F.col("n") > split), limit, runs, tables)
        of_class = ends.groupBy("set").agg(F.array_sort(F.collect_list("node")).alias("leaves"))
        small = small.unionByName(ends.join(of_class, "set").withColumns({"run": F.lit(-1), "leaf": F.col("node")}))
    blocks = F.ceil(F.col("n") / limit).cast("int")
    rows = small.withColumn("block", F.pmod(F.xxhash64("set"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    return rows.select(F.xxhash64("node", lo, hi).alias("unit"), "run", "leaf", "block", (lo == hi).alias("within"), "set", "n_docs", "path", "leaves"), tables


def _leaves(large: DataFrame, limit: int, runs: int, tables: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Parts of nodes, split on until they are small, alike, or no function is left: set, n_docs, path, node, n. A job a level."""
    bit = lambda r: F.call_function("shiftleft", F.lit(1).cast("long"), r)
    own = ["set", "n_docs", "path", "node", "n"]
    level = stored(large.select(*own, bit(F.col("run")).alias("used")), "paths-large")  # read twice a level
    tables, out = [*tables, level], None
    while True:
        spread = stored(_spread(level, runs), "paths-spread")
        free = F.filter("order", lambda x: F.col("used").bitwiseAND(bit(x["r"])) == 0)
        told = level.join(spread.hint("merge"), "node").withColumn("free", F.slice(free, 1, CHILDREN))
        last = told.filter((F.col("alike") >= ALIKE) | (F.size("free") == 0)).select(*own)
        parts = told.filter((F.col("alike") < ALIKE) & (F.size("free") > 0)).withColumn("r", F.explode("free.r")).filter(F.get("path", F.col("r")) != 0)
        parts = parts.select("set", "n_docs", "path", F.xxhash64("node", "r", F.get("path", F.col("r"))).alias("node"), F.col("used").bitwiseOR(bit(F.col("r"))).alias("used"))
        parts = stored(parts, "paths-parts")
        sizes = parts.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        now = stored(parts.join(sizes.hint("merge"), "node"), "paths-level")
        drop(parts)
        tables += [spread, now]
        ended = last.unionByName(now.filter(F.col("n") <= limit).select(*own))
        out = ended if out is None else out.unionByName(ended)
        level = now.filter(F.col("n") > limit)
        if not level.limit(1).count():
            return out, tables


def _spread(level: DataFrame, runs: int) -> DataFrame:
    """node, alike, order: the share of functions on which two classes of a node agree, and the functions by how seldom they do."""
    parts = level.select("node", "n", "path").mapInArrow(_chosen_in_nodes, "node long, n long, r int, t long, c long")
    tokens = parts.groupBy("node", "n", "r", "t").agg(F.sum("c").cast("double").alias("c"))
    agreed = tokens.groupBy("node", "n", "r").agg((F.sum(F.col("c") * F.col("c")) / (F.col("n") * F.col("n"))).alias("s"))
    return agreed.groupBy("node").agg((F.sum("s") / runs).alias("alike"), F.array_sort(F.collect_list(F.struct("s", "r"))).alias("order"))


def _chosen_in_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, r, t, c: how many of a task's classes choose each token; classes are counted HELD at a time, not written once for each function."""
    held: list[pa.RecordBatch] = []

    def counts() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        nodes, first, at = np.unique(t.column("node").to_numpy(), return_index=True, return_inverse=True)
        sizes, paths = t.column("n").to_numpy()[first], _paths(t)
        for r in range(paths.shape[1]):
            own = paths[:, r] != 0
            tokens, which = np.unique(paths[own, r], return_inverse=True)
            key, c = np.unique(at[own] * len(tokens) + which, return_counts=True)
            if len(key):
                node, token = np.divmod(key, len(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[node]), pa.array(sizes[node]), pa.array(np.full(len(key), r, np.int32)), pa.array(tokens[token]), pa.array(c)], ["node", "n", "r", "t", "c"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield from counts()
            held.clear()
    if held:
        yield from counts()


_FIELDS = "unit long, run int, leaf long, block int, within boolean, set binary, n_docs long, path array<long>, leaves array<long>"


def _groups(batches: Iterator[pa.RecordBatch], once: bool = False) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units from batches sorted by unit, and where each unit begins (with the end).

    once: rows are also sorted by set within a unit, and of rows of one set the first counts (several documents of a
    class can pass the filter).
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        u = t.column("unit").to_numpy()
        cut = int(np.searchsorted(u, u[-1], side="left"))
        if cut:
            yield _units(t.slice(0, cut), once)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield _units(rest, once)


def _units(t: pa.Table, once: bool) -> tuple[pa.Table, np.ndarray]:
    u = t.column("unit").to_numpy()
    if once:
        keys = np.frombuffer(b"".join(t.column("set").to_pylist()), dtype=np.uint64).reshape(-1, 2)
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (keys[1:] != keys[:-1]).any(1)
        if not new.all():
            t = t.filter(pa.array(new))
            u = u[new]
    return t, _starts(u)


def _starts(u: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(u[1:] != u[:-1]) + 1, [len(u)]])


def _paths(t: pa.Table) -> np.ndarray:
    return t.column("path").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in column]


def _met_before(leaves: list[np.ndarray], leaf: int) -> np.ndarray:
    """Matrix of pairs that share a part of a smaller number."""
    less = [x[: np.searchsorted(x, leaf)] for x in leaves]
    owner = np.repeat(np.arange(len(less)), [len(x) for x in less])
    names, which = np.unique(np.concatenate(less), return_inverse=True)
    m = np.zeros((len(less), len(names)), np.float32)
    m[owner, which] = 1
    return m @ m.T > 0


def _likely(paths: np.ndarray, run: int, leaf: int, leaves: list[np.ndarray], block: np.ndarray, within: bool, need: int) -> np.ndarray:
    """Matrix of pairs to compare in this unit: i < j (or of two blocks), with `need` hits, and compared in no other.

    A pair is compared in the first run whose node it shares unsplit, or else in the part of least number that it shares.
    """
    n, runs = len(paths), paths.shape[1]
    hits, before = np.zeros((n, n), np.uint16), np.zeros((n, n), bool)
    for r in range(runs):
        p = paths[:, r]
        same = (p[:, None] == p[None, :]) & (p != 0)[:, None]
        hits += same
        if r < run or run < 0:
            before |= same & (p & 1 == 0)[:, None]
    if run < 0:
        before |= _met_before(leaves, leaf)
    out = (hits >= need) & ~before
    out &= np.triu(np.ones((n, n), bool), 1)
    if not within:
        out &= block[:, None] != block[None, :]
    return out


def _with_partner(need: int):
    """The rows that have something to compare in their unit. Units of two, by far the most, are handled together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches):
            paths, run, leaf = _paths(t), t.column("run").to_numpy(), t.column("leaf").to_numpy()
            block, within, leaves = t.column("block").to_numpy(), t.column("within").to_numpy(), t.column("leaves")
            keep = np.zeros(t.num_rows, bool)
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            a, b = paths[two], paths[two + 1]
            same = (a == b) & (a != 0)
            ok = (same.sum(1) >= need) & (within[two] | (block[two] != block[two + 1]))
            plain = same & (a & 1 == 0)
            ok &= np.where(run[two] >= 0, plain.argmax(1) == run[two], ~plain.any(1))
            for i in np.flatnonzero(ok & (run[two] < 0)):
                at = int(two[i])
                ok[i] = not _met_before(_lists(leaves.slice(at, 2)), int(leaf[at]))[0, 1]
            keep[two[ok]] = keep[two[ok] + 1] = True
            for k in np.flatnonzero(sizes > 2):
                s, at = slice(starts[k], starts[k + 1]), starts[k]
                told = _lists(leaves.slice(at, sizes[k])) if run[at] < 0 else []
                likely = _likely(paths[s], run[at], leaf[at], told, block[s], bool(within[at]), need)
                keep[s] = likely.any(0) | likely.any(1)
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    return work


def _overlaps(sets: list[np.ndarray], likely: np.ndarray) -> np.ndarray:
    """Sizes of intersections, exact wherever `likely` holds."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    if likely.sum() <= FEW or n <= 4:
        for i, j in zip(*np.nonzero(likely), strict=True):
            out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    tokens, which, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.full(len(tokens), -1)
    rank[df > 1] = np.arange((df > 1).sum())  # a token of one set adds to no intersection
    column = rank[which]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int((df > 1).sum()), CHUNK):
        lo, hi = np.searchsorted(column, [at, at + CHUNK])
        m = np.zeros((n, CHUNK), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


def _verified(similarity: float, need: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches, once=True):
            paths, run, leaf, n_docs = _paths(t), t.column("run").to_numpy(), t.column("leaf").to_numpy(), t.column("n_docs").to_numpy()
            block, within, leaves = t.column("block").to_numpy(), t.column("within").to_numpy(), t.column("leaves")
            keys, raw = t.column("set").to_pylist(), t.column("tokens")
            found: list[tuple[bytes, int, bytes]] = []
            for k in range(len(starts) - 1):
                s, at = slice(starts[k], starts[k + 1]), starts[k]
                told = _lists(leaves.slice(at, starts[k + 1] - at)) if run[at] < 0 else []
                likely = _likely(paths[s], run[at], leaf[at], told, block[s], bool(within[at]), need)
                if not likely.any():
                    continue
                sets = [np.frombuffer(raw[i].as_py(), np.uint64) for i in range(starts[k], starts[k + 1])]
                size = np.array([len(x) for x in sets], np.float64)
                both = _overlaps(sets, likely)
                linked = likely & (both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9)
                linked |= linked.T
                docs = linked @ n_docs[s]
                root = np.arange(len(sets))
                while True:  # the least member that each is linked to, step by step
                    new = np.minimum(root, np.where(linked, root[None, :], len(sets)).min(1))
                    if (new == root).all():
                        break
                    root = new
                found += [(keys[starts[k] + i], int(docs[i]), keys[starts[k] + root[i]]) for i in np.flatnonzero(docs)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["set", "docs", "root"])

    return work


def _bloom(hashes: DataFrame) -> np.ndarray:
    """Bits of a column th: 16 for each row, but MAX_BITS at most, so that its size is bounded; a full filter lets all pass."""
    bits = 1 << min(MAX_BITS, max(10, (16 * hashes.count()).bit_length()))
    places = hashes.select(F.explode(F.array(*[F.pmod(F.xxhash64("th", F.lit(i)), F.lit(bits)) for i in range(4)])).alias("at"))
    words = places.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits"))
    out = np.zeros(max(1, bits >> 5), np.uint32)
    got = words.toPandas()
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def _tokens(words: int, bloom):
    """Sets of the documents that pass the filter, keyed like the classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits = bloom.value
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for i in range(4):
                at = batch.column(1 + i).to_numpy()
                ok &= (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0
            made = [shingles(batch.column(0)[int(i)].as_py(), words).tobytes() for i in np.flatnonzero(ok)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in made], pa.binary()), pa.array(made, pa.binary())], ["set", "tokens"])
        _words.clear()

    return work


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, limit: int = LIMIT, split: int = SPLIT) -> DataFrame:
    """id, th, set_id, class_id, n_links: a row for each document.

    set_id: smallest identifier among documents of the same shingle set; class_id: smallest in the connected group of
    documents linked at `similarity`; n_links: how many other documents this one is linked to, copies included.
    """
    runs, need = runs_and_need(similarity)
    sketches = stored(_sketches(docs, id_col, text_col, words, runs), "paths-sketches")
    one = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "th"))
    classes = sketches.groupBy("set").agg(F.count("*").alias("n_docs"), one.alias("rep"), F.first("k1").alias("k1"))
    classes = stored(classes.select("set", "n_docs", F.col("rep.id").alias("set_id"), F.col("rep.th").alias("rep_th"), "k1"), "paths-classes")
    nodes, tables = _nodes(classes, limit, split, runs)
    likely = stored(nodes.repartition("unit").sortWithinPartitions("unit").mapInArrow(_with_partner(need), _FIELDS), "paths-likely")
    drop(*tables)
    wanted = stored(classes.join(likely.select("set").distinct(), "set").select(F.col("rep_th").alias("th")), "paths-wanted")
    bloom = _bloom(wanted)
    told = docs.sparkSession.sparkContext.broadcast(bloom)
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    places = [F.pmod(F.xxhash64(th, F.lit(i)), F.lit(32 * len(bloom))).alias(f"p{i}") for i in range(4)]
    sets = docs.select(F.col(text_col).alias("t"), *places).mapInArrow(_tokens(words, told), "set binary, tokens binary")
    units = likely.join(sets, "set").repartition("unit").sortWithinPartitions("unit", "set")
    found = stored(units.select("unit", "run", "leaf", "block", "within", "set", "n_docs", "path", "leaves", "tokens").mapInArrow(_verified(similarity, need), "set binary, docs long, root binary"), "paths-links")
    drop(likely, wanted)
    links = found.groupBy("set").agg(F.sum("docs").alias("links"))
    roots = connected(found.select(F.col("set").alias("a"), F.col("root").alias("b")), "paths-components")
    known = classes.select("set", "n_docs", "set_id").join(links, "set", "left").join(roots.withColumnRenamed("node", "set"), "set", "left")
    known = known.withColumn("root", F.coalesce("root", "set"))
    names = known.groupBy("root").agg(F.min("set_id").alias("class_id"))
    known = stored(known.join(names, "root").select("set", "n_docs", "set_id", "class_id", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "paths-known")
    rows = sketches.count()
    return look_up(sketches.select("id", "th", "set"), known, "set", "n_docs", rows).select("id", "th", "set_id", "class_id", "n_links")


def keep_one(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the smallest identifier of each group, with the columns of `docs`."""
    joined = stored(joined, "paths-joined")
    stays = F.col("id").eqNullSafe(F.col("class_id"))
    plain = [F.col(f"`{c}`") for c in docs.columns]
    th, key, number = fresh(docs, "__th", "__key", "__number")
    marked = docs.withColumn(th, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("k.id")) & (F.col(f"d.{th}") == F.col("k.th"))
    if joined.filter(stays).groupBy("class_id").count().filter("count > 1").limit(1).count():  # an identifier stands twice in a group
        first = F.row_number().over(Window.partitionBy("class_id").orderBy("th"))
        kept = joined.filter(stays).withColumn("k", first).filter("k = 1").select("id", "th")
        twin = F.row_number().over(Window.partitionBy(id_col, th).orderBy(F.lit(1)))
        return marked.withColumn(number, twin).filter(F.col(number) == 1).alias("d").join(kept.alias("k"), same, "left_semi").select(*plain)
    dropped = joined.filter(~stays).select("id", "th")
    maybe, rest = parted(marked.withColumn(key, F.xxhash64(id_col)), dropped.select(F.xxhash64("id").alias(key)), key)
    return maybe.alias("d").join(dropped.alias("k"), same, "left_anti").select(*plain).unionByName(rest.select(*plain))
