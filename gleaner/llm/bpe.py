"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Encoding has two tiers. A pre-token that is itself a vocabulary entry is resolved by one probe of a minimal
perfect hash (hash and displace). All others are merged: their bytes form a doubly linked list, and a heap holds
the mergeable neighbours by rank, then by place, so that n bytes take O(n log n) time however long the pre-token.

Defined cases: null and empty texts have no tokens and decode to no bytes; repeated rows are encoded alike; of equal
ranks the leftmost neighbours are merged first; an empty table gives an empty result; extra columns are left out unless named in `keep`; texts of any length are cut into pre-tokens in slices of bounded size.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts over so many code points are cut lazily, so many pre-tokens at a time.
LONG_TEXT, SLICE = 2_000_000, 65_536
#: Pre-tokens that a worker remembers, and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
#: A record batch is handed over when it holds so many tokens.
BATCH_TOKENS = 1_000_000
_MIX, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class MinimalPerfectHash:
    """n keys to the slots 0..n-1, one key a slot; a foreign key gets some slot and fails the comparison there."""

    def __init__(self, keys: list[bytes], load: int = 4):
        import xxhash

        self.n = max(1, len(keys))
        self.buckets = max(1, len(keys) // load)
        self.seeds = [0] * self.buckets
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        taken, self.order = bytearray(self.n), [-1] * self.n
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) > 1:
                seed, slots = 0, []
                while not slots:
                    seed += 1
                    found = {self._slot(hashes[i], seed) for i in own}
                    if len(found) == len(own) and not any(taken[s] for s in found):
                        slots = [self._slot(hashes[i], seed) for i in own]
                self.seeds[b] = seed
                for i, s in zip(own, slots, strict=True):
                    taken[s], self.order[s] = 1, i
            elif own:  # a bucket of one key names its slot itself
                free = free if free is not None else iter([s for s in range(self.n) if not taken[s]])
                s = next(free)
                self.seeds[b], taken[s], self.order[s] = -s - 1, 1, own[0]

    def _slot(self, h: int, seed: int) -> int:
        x = ((h ^ (seed * _MIX)) * 0xBF58476D1CE4E5B9) & _MASK
        return ((x ^ (x >> 31)) >> 7) % self.n

    def slot(self, h: int) -> int:
        seed = self.seeds[h % self.buckets]
        return -seed - 1 if seed < 0 else self._slot(h, seed)


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, lines)]


def pairs_of(entries: list[tuple[bytes, int]]) -> dict[tuple[int, int], int]:
    """Each way to make a token of two: (left id, right id) to the token's id."""
    ranks = dict(entries)
    return {(a, b): r for t, r in entries for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}


class Codec:
    """Encoder and decoder for one vocabulary; ranks serve as ids."""

    def __init__(self, entries: list[tuple[bytes, int]], pattern: str, mph: MinimalPerfectHash | None = None, pairs: dict | None = None):
        import regex
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.cut = regex.compile(pattern)
        self.mph = mph or MinimalPerfectHash([t for t, _ in entries])
        self.keys = [entries[i][0] if i >= 0 else None for i in self.mph.order]
        self.ranks = [entries[i][1] if i >= 0 else -1 for i in self.mph.order]
        self.bytes_of = {r: t for t, r in entries}
        self.single = [self.rank(bytes([b])) for b in range(256)]
        self.as_bytes = bytes(self.single) if max(self.single) < 256 else None
        self.pairs = pairs if pairs is not None else pairs_of(entries)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def rank(self, token: bytes) -> int | None:
        s = self.mph.slot(self.digest(token))
        return self.ranks[s] if self.keys[s] == token else None

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost among equals; neighbours are linked by index.

        A heap entry is one number: rank, then place. It is stale if the pair at its place has another rank by now.
        """
        n = len(piece)
        ids = list(piece.translate(self.as_bytes)) if self.as_bytes else [self.single[b] for b in piece]
        pairs, push, pop = self.pairs.get, heapq.heappush, heapq.heappop
        heap = [r << 32 | i for i, r in enumerate(map(pairs, zip(ids, ids[1:]))) if r is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or pairs((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], k = rank, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := pairs((rank, ids[k]))) is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := pairs((ids[h], rank))) is not None:
                push(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        """The ids of a pre-token as 32-bit integers, so that those of a text are joined without boxing them."""
        known = self.memory.get(text) or self.older.get(text)
        if known is None:
            raw = text.encode("utf-8")
            whole = self.rank(raw)
            known = array("i", [whole] if whole is not None else self.merge(raw)).tobytes()
        if len(text) <= REMEMBERED_CHARS:
            if len(self.memory) >= REMEMBERED:
                self.memory, self.older = {}, self.memory
            self.memory[text] = known
        return known

    def slices(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.cut.findall(text)
            return
        found = (m.group() for m in self.cut.finditer(text))
        while part := list(islice(found, SLICE)):
            yield part

    def encode(self, text: str) -> np.ndarray:
        piece, parts = self.piece, []
        for found in self.slices(text):
            known = self.memory.get
            parts.append(b"".join([known(x) or piece(x) for x in found]))
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}
_built: dict[str, tuple] = {}


def vocabulary_of(path: str) -> tuple[list[tuple[bytes, int]], MinimalPerfectHash, dict]:
    """The entries of a vocabulary file, their hash and their pairs, built once in a driver."""
    if path not in _built:
        entries = read_ranks(path)
        _built[path] = entries, MinimalPerfectHash([t for t, _ in entries]), pairs_of(entries)
    return _built[path]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, then token_ids array<int> and decoded binary (the bytes that the ids stand for).

    The vocabulary (a fixed file of about 1 MB) is read once on the driver and broadcast; executors need no copy.
    One pass without a shuffle; each task holds one record batch and a memory of REMEMBERED pre-tokens.
    """
    spark = docs.sparkSession
    entries, mph, pairs = vocabulary_of(vocabulary)
    told = spark.sparkContext.broadcast((entries, pattern, mph, pairs))
    plain = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    fields = [f for f in plain.schema.fields if f.name != "__text"]
    schema = T.StructType([*fields, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get((vocabulary, pattern))
        if codec is None:
            codec = _codecs[vocabulary, pattern] = Codec(*told.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            names = [x for x in batch.schema.names if x != "__text"]
            start, ids, raw, held = 0, [], [], 0
            for k in range(batch.num_rows):
                got = codec.encode(texts[k].as_py())
                ids.append(got)
                raw.append(codec.decode(got))
                held += len(got)
                if held >= BATCH_TOKENS or k == batch.num_rows - 1:
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                    part = [batch.column(batch.schema.get_field_index(x)).slice(start, k + 1 - start) for x in names]
                    yield pa.RecordBatch.from_arrays([*part, lists, pa.array(raw, pa.binary())], [*names, "token_ids", "decoded"])
                    start, ids, raw, held = k + 1, [], [], 0
        codec.memory, codec.older = {}, {}  # an idle worker gives the memory back

    return plain.mapInArrow(work, schema)


def digests(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token count and digests of ids and decoded bytes."""
    return encoded.select(
        *keep,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
