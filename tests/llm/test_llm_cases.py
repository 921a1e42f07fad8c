"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bpe, exact_dedup, fingerprints, html_text, jaccard_join, language, licenses, mixing, quality, shared, url_filter
from llm.helpers import near_pairs, union_find

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, keep_id string, size string, `rank` string, digest string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def table(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "en", s, 0, "a", "b", "c", "d", "e") for i, t, s in zip(ids, texts, ["s1", None, "s0", "s2"] * len(texts), strict=False)]
    return spark.createDataFrame(rows, SCHEMA)


TEXTS = [None, "", "  \n\t", "one", "a b c d e f g h", "a b c d e f g h", "A b c d\ne f g h", LONG, LONG + " end", "Élan vital! ¿Qué? 日本語 " * 20, "x" * 50_000]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [*TEXTS, "one"], [*range(len(TEXTS)), 3])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_dedup(odd, empty, spark):
    got = exact_dedup.report(exact_dedup.decide(odd)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by[0] == [(2, 3, False)] and by[2] == [(2, 3, True)] and by[5] == [(4, 2, False)] and by[6] == [(6, 1, True)]
    assert sorted(by[3]) == [(3, 2, False), (3, 2, True)]
    assert exact_dedup.report(exact_dedup.decide(empty)).count() == 0
    kept = exact_dedup.keep_one(odd, shared.stored(exact_dedup.decide(odd), "t"))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 7, 8, 9, 10]


def test_dedup_tells_colliding_digests_apart(spark):
    docs = table(spark, [f"text {i % 40}" for i in range(400)])
    want = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.report(exact_dedup.decide(docs)).collect()}
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.report(exact_dedup.decide(docs, digest_bytes=0)).collect()}
    assert got == want and len(want) == 400
    assert {(i, i % 40, 10, i < 40) for i in range(400)} == want


def test_dedup_flushes_full_memtables(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE", 7)
    docs = table(spark, [f"t{i % 30}" for i in range(300)])
    assert {(r.keep_id, r.group_size) for r in exact_dedup.decide(docs).collect()} == {(i, 10) for i in range(30)}


def test_dedup_runs_are_files_and_batches_are_merged(spark, monkeypatch):
    """Each file is one sorted run; a level of two batches equals the level of all rows; alone, a row needs no join."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(exact_dedup, "MEMTABLE", 7)
    docs = table(spark, [f"t{i % 70}" for i in range(210)])
    keyed = docs.select(F.col("doc_id").alias("id"), F.lit(3).cast("long").alias("n_chars"), F.md5("text").cast("binary").alias("digest"))
    runs = exact_dedup.flush(keyed)
    for name in runs.inputFiles():
        digests = pq.read_table(name.removeprefix("file://"), columns=["digest"]).column(0).to_pylist()
        assert len(digests) <= 7 and digests == sorted(set(digests))
    first = exact_dedup.add(docs.filter("doc_id < 100"))
    both = exact_dedup.add(docs.filter("doc_id >= 100"), first)
    assert sorted(map(str, both.collect())) == sorted(map(str, exact_dedup.add(docs).collect()))
    assert {(r.keep_id, r.group_size) for r in both.collect()} == {(i, 3) for i in range(70)}
    few = table(spark, ["a", "b", "c", "a"])
    keyed = few.select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("n_chars"), F.md5("text").cast("binary").alias("digest"))
    maybe, alone = shared.parted(keyed, exact_dedup._several(exact_dedup.add(few)).select("digest"), "digest")
    found = exact_dedup.look_up_all(keyed, exact_dedup.compact(exact_dedup.flush(keyed)), 4)
    assert {(r.id, r.keep_id, r.group_size) for r in found.collect()} == {(0, 0, 2), (3, 0, 2), (1, 1, 1), (2, 2, 1)} and maybe.count() + alone.count() == 4


def test_dedup_of_other_id_types_and_a_hot_text(spark):
    for kind in ("smallint", "string", "decimal(12,0)", "date"):
        value = "date_add(date'2020-01-01', cast(doc_id as int))" if kind == "date" else f"cast(doc_id as {kind})"
        docs = table(spark, ["q", "q", None, "z"]).selectExpr(f"{value} AS doc_id", "text")
        assert [r.kept for r in exact_dedup.report(exact_dedup.decide(docs)).orderBy("doc_id").collect()] == [True, False, True, True]
    docs = table(spark, ["hot text"] * 1500 + [f"t{i}" for i in range(1500)])
    got = exact_dedup.decide(docs).groupBy("keep_id").agg(F.max("group_size").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()
    assert len(got) == 1501 and {(r.n, r.k) for r in got} == {(1500, 1), (1, 1)}


def test_columns_with_names_of_our_own_pass_through(spark):
    names = ["__key", "__n", "__words", "__size", "__number", "__times", "__chars", "__sha", "__hot", "__word", "__bits", "__th", "id", "sha", "copies", "__text", "__html"]
    docs = table(spark, ["a b c d e f", "a b c d e f", "other words here", None, "x"]).select("doc_id", "text", "source", *[F.lit(f"mine {n}").alias(n) for n in names])
    done = [exact_dedup.keep_one(docs, shared.stored(exact_dedup.decide(docs), "t")), jaccard_join.keep_one(docs, jaccard_join.join(docs)), mixing.apply_mix(docs, shared.stored(mixing.decide(docs), "t"))]
    for out in done:
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[n] == f"mine {n}" for r in rows for n in names)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Cluster)
    made = shared.stored(spark.range(3), "t")
    path = made.inputFiles()[0].removeprefix("file://")
    shared.drop(made)
    assert not Path(path).exists()


def test_dedup_null_ids(spark):
    got = exact_dedup.report(exact_dedup.decide(table(spark, ["q", "q", "z"], [None, 5, None]))).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(None, 5, False), (5, 5, True), (None, None, True)}


def test_jaccard(odd, empty):
    got = jaccard_join.join(odd).collect()
    assert len(got) == odd.count() and jaccard_join.join(empty).count() == 0
    by = {r.id: (r.class_id, r.n_links) for r in got}
    assert by[0] == by[1] == by[2] == (0, 2) and by[4] == by[5] == by[6] == (4, 2) and by[7] == by[8] == (7, 1) and by[3] == (3, 1) and by[9] == (9, 0)
    kept = jaccard_join.keep_one(odd, jaccard_join.join(odd))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 7, 9, 10]


def test_jaccard_with_hot_groups_and_split_nodes(spark):
    """A large group of near-copies, a passage that all share, and nodes over the limit: nothing is lost."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, passage = [word() for _ in range(120)], " ".join(word() for _ in range(30))
    texts = []
    for _ in range(150):
        w = list(base)
        w[rng.randrange(120)] = word()
        texts.append(" ".join(w))
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(150)] + [passage] * 20
    pairs = near_pairs(texts)
    root, links = union_find(len(texts), pairs), [0] * len(texts)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for split in (5000, 40):  # blocks alone, and nodes split before
        got = {r.id: (r.class_id, r.n_links) for r in jaccard_join.join(table(spark, texts), limit=20, split=split).collect()}
        assert got == {k: (root[k], links[k]) for k in range(len(texts))}


def test_jaccard_meets_pairs_in_split_nodes(spark):
    """Near copies at about 0.81 in a node that is split: recall as the docstring says, and each found pair counts once."""
    base = [f"b7w{i}" for i in range(96)]
    texts = [" ".join([*base[: 5 + k % 86], f"x{k}", *base[6 + k % 86 :]]) for k in range(250)]
    links = [0] * 250
    for i, j in near_pairs(texts):
        links[i] += 1
        links[j] += 1
    got = {r.id: r.n_links for r in jaccard_join.join(table(spark, texts), limit=250, split=30).collect()}
    assert all(got[k] <= links[k] for k in got) and sum(got.values()) >= 0.999 * sum(links) > 50_000


def test_jaccard_recall_where_nodes_are_split_four_times(spark):
    """Pairs at about 0.8 among texts that share most of a passage, with buckets of two so that nodes are split four times."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, texts, pairs = [word() for _ in range(60)], [], set()
    for k in range(1500):
        own = [word() for _ in range(44)]
        texts += [" ".join([*passage, *own]), " ".join([*passage, *own[:-11], *(word() for _ in range(11))])]
        pairs.add((2 * k, 2 * k + 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {p for p in near_pairs(texts[:40])}
    assert near == {p for p in pairs if p[1] < 40}  # 89 shingles of 111 are common: 0.802
    sketches = jaccard_join._sketches(docs, "doc_id", "text", 5, 16).groupBy("set").agg(F.count("*").alias("n_docs"), F.first("k1").alias("k1"))
    nodes, tables = jaccard_join._nodes(sketches, 2, 4, 16)
    assert len(tables) // 2 >= 4  # more than that no node of these needs, however small the buckets
    got = jaccard_join.join(docs, split=4, limit=2)
    found = {r.id for r in got.filter("n_links > 0").collect()}
    assert sum(a in found and b in found for a, b in pairs) >= 0.99 * len(pairs)


def test_jaccard_splits_a_large_node_of_unlike_texts(spark):
    """Thousands of classes that share half of their shingles: nodes are split to small ones, and the planted pairs are found."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage, texts = [word() for _ in range(40)], []
    for k in range(6000):
        if k % 10 == 9:
            own = [*own[:-2], word(), word()]
        else:
            own = [word() for _ in range(36)]
        texts.append(" ".join([*passage, *own]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard_join.join(docs, split=500, limit=100).filter("n_links > 0 OR class_id <> id").collect()
    want = {k for k in range(6000) if k % 10 >= 8}
    assert {r.id for r in found} == want and all(r.n_links == 1 and r.class_id == r.id - (r.id % 10 == 9) for r in found)
    sketches = jaccard_join._sketches(docs, "doc_id", "text", 5, 16).groupBy("set").agg(F.count("*").alias("n_docs"), F.first("k1").alias("k1"))
    nodes, tables = jaccard_join._nodes(sketches, 100, 500, 16)
    sizes = nodes.groupBy("unit").count().agg(F.max("count"), F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
    assert sizes[0] <= 300 and sizes[2] < 0.1 * 6000**2  # by blocks alone each run would compare half of all pairs
    jaccard_join.drop(*tables)


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("200", "300"), ("300", "250"), ("400", "400")]
    got = {r.node: r.root for r in shared.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"{i:03d}": "000" for i in range(61)}, "200": "200", "250": "200", "300": "200"}
    assert shared.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_look_up_and_sift(spark):
    left = spark.createDataFrame([(i % 3 if i < 3000 else i, i) for i in range(3300)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("w"))
    got = shared.look_up(left, right, "k", "w", 1000)
    assert got.count() == 3300 and got.filter("w = 1000").count() == 3000
    keys = spark.createDataFrame([(5000,), (1,)], "k long")
    sifted = shared.sift(left, keys, "k")
    assert 1000 <= sifted.count() < 3300 and sifted.filter("k = 1").count() == 1000


def test_bpe(odd, empty, spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.encode_decode(odd, path, P.PATTERN).collect()
    texts = dict(enumerate(TEXTS))
    assert len(got) == odd.count() and all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in got)
    assert bpe.encode_decode(empty, path, P.PATTERN).count() == 0
    entries, mph, pairs = bpe.vocabulary_of(path)
    assert sorted(mph.order) == list(range(len(entries)))
    codec = bpe.Codec(entries, P.PATTERN, mph, pairs)
    assert codec.rank(b"no such token at all") is None
    old = bpe.LONG_TEXT
    try:  # the lazy cut of long texts gives the same tokens
        bpe.LONG_TEXT, bpe.SLICE = 10, 7
        lazy = codec.encode(LONG[:5000]).tolist()
    finally:
        bpe.LONG_TEXT, bpe.SLICE = old, 65_536
    assert lazy == codec.encode(LONG[:5000]).tolist()


def test_fingerprints(odd, empty, spark):
    got = fingerprints.report(fingerprints.compare_edited(odd)).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[4].fingerprint == by[5].fingerprint
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == "" and by[8].near_next > 0.9 and all(0 <= r.near_edited <= 1 for r in got)
    assert fingerprints.report(fingerprints.compare_edited(empty)).count() == 0
    single = fingerprints.report(fingerprints.compare_edited(table(spark, ["a b c d"], [9]))).first()
    assert single.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest() and single.near_next == 1.0


def plain_order_minhash(text, k=2, bits=6):
    """Order MinHash with buckets, in plain Python: hashes of numbered k-mers from Spark's own function are given by the caller."""
    w = [x for x in text.replace("\n", " ").split(" ") if x]
    seen, kmers = {}, []
    for i in range(max(1, len(w) - k + 1)) if w else []:
        key = tuple(w[i : i + k])
        kmers.append((key, seen.get(key, 0), i))
        seen[key] = seen.get(key, 0) + 1
    return kmers


def test_fingerprints_against_plain_order_minhash(spark):
    """Likeness of the signatures against the definition: minimal numbered k-mers of each bucket, in text order, compared as tuples."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(3)]
    for t in list(texts):
        w = t.split()
        for _ in range(6):
            w[rng.randrange(150)] = rng.choice(vocabulary)
        texts += [" ".join(w), " ".join(w[75:] + w[:75])]
    mask = ~((1 << 31) - 1)
    kmers = [plain_order_minhash(t) for t in texts]
    words = spark.createDataFrame([(i, j, *key, o, p) for i, ks in enumerate(kmers) for j, (key, o, p) in enumerate(ks)], "t int, j int, a string, b string, o int, p int")
    h = F.xxhash64(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).bitwiseAND(F.lit(mask)), "o")
    tuples = [{} for _ in texts]
    for r in words.select("t", "p", h.alias("h")).collect():
        tuples[r.t].setdefault((r.h & ((1 << 64) - 1)) >> 58, []).append((r.h & mask, r.p))
    picked = []
    for buckets in tuples:
        picked.append({b: tuple(x for x, _ in sorted(sorted(rows)[:2], key=lambda y: y[1])) for b, rows in buckets.items()})
    d = fingerprints.fingerprinted(table(spark, texts).select("doc_id", "text"), "text", "sig")
    a, b = d.alias("a"), d.alias("b")
    near = a.join(b, F.col("a.doc_id") < F.col("b.doc_id")).select("a.doc_id", "b.doc_id", fingerprints.likeness(F.col("a.sig"), F.col("b.sig"))).collect()
    for i, j, got in near:
        filled = picked[i].keys() | picked[j].keys()
        want = sum(picked[i].get(x) == picked[j].get(x) for x in filled) / len(filled)
        assert got == pytest.approx(want, abs=1e-9), (i, j)


def test_fingerprints_of_texts_without_spaces(spark):
    rng = random.Random(4)
    run = "".join(rng.choice("abcdefghijklmnop日本語文字") for _ in range(2000))
    texts = [run, "x" + run, run[:900] + "yy" + run[900:], "".join(reversed(run)), "short " + run]
    d = fingerprints.fingerprinted(table(spark, texts).select("doc_id", "text"), "text", "sig").collect()
    sig = {r.doc_id: set(r.sig) for r in d}
    like = lambda i: len(sig[0] & sig[i]) / len({x >> 32 for x in sig[0] | sig[i]})
    assert like(1) > 0.8 and like(2) > 0.8 and like(3) < 0.1 and like(4) > 0.8


def test_fingerprint_ranges_are_found_in_groups(spark):
    for cuts in ([], [5], [3, 9], list(range(0, 100, 7)), [2, 2.5, 4, 8, 16, 32, 64]):
        got = spark.range(-2, 110).select("id", fingerprints._above(F.col("id"), cuts).alias("n")).collect()
        assert all(r.n == sum(c > r.id for c in cuts) for r in got)


def test_fingerprints_depend_on_order_and_ranges(spark):
    w = [f"v{i}" for i in range(200)]
    texts = [" ".join(w), " ".join(w[100:] + w[:100]), " ".join(reversed(w)), " ".join(f"u{i}" for i in range(200))]
    d = fingerprints.fingerprinted(table(spark, texts).select("doc_id", "text"), "text", "sig")
    a, b = d.alias("a"), d.alias("b")
    near = {(r[0], r[1]): r[2] for r in a.join(b, F.col("a.doc_id") < F.col("b.doc_id")).select("a.doc_id", "b.doc_id", fingerprints.likeness(F.col("a.sig"), F.col("b.sig"))).collect()}
    assert 0.1 < near[0, 1] < 1 and near[0, 2] < near[0, 1] and near[0, 3] == 0
    docs = table(spark, [f"t{i}" for i in range(50)], [i * 7 % 50 for i in range(50)]).select("doc_id", "text")
    follow = {r.doc_id: r.next_doc_id for r in fingerprints.with_next(docs, "doc_id", "text", ("doc_id",), range_rows=6).collect()}
    assert follow == {i: (i - 1) % 50 for i in range(50)}


MIT = """MIT License

Copyright (c) 2019 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD3 = """Copyright 2011 The Owners. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of Some Firm Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE).
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GNU = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation{2} either version {3} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {1}General Public License for more details.

You should have received a copy of the GNU {1}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
ISC = """ISC License

Copyright (c) 2004-2010 by Some Consortium, Inc. ("ISC")

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES.
"""
PUBLISHED = {
    "MIT": MIT, "BSD-3-Clause": BSD3, "BSD-2-Clause": BSD3.replace(BSD3[BSD3.index("   * Neither") : BSD3.index("THIS SOFTWARE")], "\n"), "Apache-2.0": APACHE,
    "GPL-3.0-or-later": GNU.format(":", "", ",", 3), "GPL-2.0-or-later": GNU.format(";", "", ";", 2), "LGPL-2.1-or-later": GNU.format(";", "Lesser ", ";", "2.1"),
    "AGPL-3.0-or-later": GNU.format(":", "Affero ", ",", 3), "MPL-2.0": MPL, "ISC": ISC, "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International Licence.",
    "LGPL-3.0-only": "SPDX-License-Identifier: LGPL-3.0-only\ncode follows",
}


def test_published_licenses(spark):
    """As published, on one line, and as comments of three kinds, after and before other text."""
    ways = [
        lambda t: t, lambda t: " ".join(t.split()), lambda t: "".join(f"// {x}\n" for x in t.splitlines()), lambda t: "".join(f"#   {x}\r\n" for x in t.splitlines()),
        lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\nint main", lambda t: f"Some words without an end\n{t}\n\nMore words.",
    ]
    cases = [(name, way(text)) for name, text in PUBLISHED.items() for way in ways]
    got = {r.doc_id: r for r in licenses.scan(table(spark, [t for _, t in cases])).collect()}
    for i, (name, text) in enumerate(cases):
        if "SPDX" in text and "\n" not in text.strip():
            continue  # on one line with what follows, the identifier has no end
        assert got[i].licenses == [name], (name, text[:200], got[i])
    assert got[0].n_unknown == 0 and got[0].n_unclaimed == 1  # the copyright line


def test_licenses(odd, empty, spark):
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(odd).collect()}
    assert got == {i: ([], [], 0, 0, 0) for i in range(len(TEXTS))} and licenses.scan(odd).count() == odd.count()
    assert licenses.scan(empty).count() == 0
    text = "Intro. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nReleased under the MIT License.\nAn unheard-of license text here\nAll rights reserved"
    r = licenses.scan(table(spark, [text])).first()
    assert r.licenses == ["Apache-2.0", "MIT"] and r.sentence_ids == ["ApacheVer2", "ApacheNotUse", "MitName", "AllRights"] and (r.n_known, r.n_unclaimed, r.n_unknown) == (4, 1, 0)
    long = LONG + ". " + MIT + "\nlicense words " * 40_000 + "\n\nreleased under the mit license"
    r = licenses.scan(table(spark, [long])).first()
    assert r.licenses == ["MIT"] and r.sentence_ids[-1] == "MitName" and r.n_unknown == 1


def test_license_sentences_of_a_caller(spark):
    """A known sentence without a cue word is found as well."""
    docs = table(spark, ["Hello there. Share and enjoy!\nBye", "no such thing"])
    got = [r.licenses for r in licenses.scan(docs, sentences=(("Joy", "share and enjoy"),), rules=(("JOY", ("Joy",)),), patterns=()).orderBy("doc_id").collect()]
    assert got == [["JOY"], []]


def test_license_sql_on_published_texts(spark):
    import duckdb

    texts = [t for t in PUBLISHED.values()] + ["".join(f"# {x}\n" for x in t.splitlines()) for t in PUBLISHED.values()] + ["a licence\nreleased under the MIT licence", None, ""]
    docs = table(spark, texts).select("doc_id", "text")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    mine, theirs = licenses.summary(licenses.scan(docs)).collect(), con.sql(licenses.oracle()).fetchall()
    assert sorted(map(tuple, mine)) == sorted(theirs) and len(mine) == len(texts)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7x?q", "https://a.b.example.com/en/8", "http://x.net/de/1", "http://sub.example.net/de/8#f", "ftp://y.org/es/", "http://org/es/q", "http://notcom/en/1", "http://q.com"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_frame(spark)).collect()}
    block, allow = (lambda x: (x, "block")), (lambda x: (x, "allow"))
    assert got == {0: allow(None), 1: allow(None), 2: allow(None), 3: allow("example.com/en/7"), 4: block("com/en/"), 5: allow("net/de/"), 6: block("example.net/de/8"), 7: block("org/es/"), 8: block("org/es/"), 9: allow(None), 10: allow(None)}
    assert url_filter.judge(pages, url_filter.rules_frame(spark).limit(0)).filter("verdict <> 'allow'").count() == 0
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark)).count() == 0
    many = spark.createDataFrame([(f"h{i}.com", f"/p{i}", "block") for i in range(500)], "host string, path string, verdict string")
    hits = spark.createDataFrame([(i, f"http://w.h{i}.com/p{i}/x") for i in range(0, 1000, 9)], "page_id long, url string")
    for literal in (2000, 100):  # the filter in the plan, and as a table
        assert {r.page_id: r.verdict == "block" for r in url_filter.judge(hits, many, literal=literal).collect()} == {i: i < 500 for i in range(0, 1000, 9)}
    listed = many.select(F.concat_ws("\0", "host", "path").alias("k"))
    table_, blocks = url_filter.block_table(listed, 500)
    assert url_filter.in_table(listed, table_, blocks).count() == 500
    assert url_filter.in_table(spark.range(10_000).select(F.concat(F.lit("no"), F.col("id").cast("string")).alias("k")), table_, blocks).count() < 200


def test_language(odd, empty, spark):
    train = table(spark, ["the cat sat on the mat and the dog"] * 5 + ["el gato se sienta en la casa y el perro"] * 5).withColumn("lang", F.when(F.col("doc_id") < 5, "en").otherwise("es"))
    model = language.train(train)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] in ("en", "es") and 0 < got[3][1] <= 1
    assert language.predict(table(spark, ["the dog and the mat", "el perro y la casa", "12 34 !"]), model).orderBy("doc_id").select("lang_pred").toPandas().lang_pred.tolist() == ["en", "es", "und"]
    assert language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.train(empty)).collect()} == {"und"}
    assert {r.lang_pred for r in language.predict(odd.filter("doc_id > 2"), language.train(train.filter("lang = 'en'"))).collect()} == {"en"}
    for n in (2, 3, 4, 9):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n
    assert np.array_equal(language.counts("abc " * 10), language.counts("abc " * 10))


def test_language_slices_lose_nothing(monkeypatch):
    text = "the quick brown fox " * 50
    whole = language.counts(text)
    monkeypatch.setattr(language, "SLICE", 37)
    assert np.array_equal(language.counts(text), whole)


def test_quality(odd, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = table(spark, [("good plain words in a row number " + str(i)) if i % 2 else f"BAD!! SHOUT!! NOISE!! {i}!!" for i in range(40)])
    model = quality.train(docs, labels)
    assert model[1] and [r.predicted for r in quality.score(docs, model).orderBy("doc_id").collect()] == [i % 2 for i in range(40)]
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0 and quality.train(docs, labels.limit(0)) == (0.0, [])
    assert quality.score(odd, quality.train(empty, labels)).first().score == 0.5
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 20


def test_mixing(odd, empty, spark):
    got = mixing.taken(mixing.decide(odd)).collect()
    sizes = [len((t or "").split()) for t in [*TEXTS, "one"]]
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted(zip([*range(len(TEXTS)), 3], sizes, strict=True))
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got) and all(r.taken == 0 for r in got if r.doc_id in (0, 1, 2))
    assert mixing.decide(empty).count() == 0 and mixing.apply_mix(empty, shared.stored(mixing.decide(empty), "t")).count() == 0
    made = shared.stored(mixing.decide(odd), "t")
    mixed = mixing.apply_mix(odd, made)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in made.collect())


def test_mixing_takes_small_sources_by_their_chances(spark):
    """400 sources of one make, of 12 documents each: every document is taken about as often as its fraction says."""
    docs = spark.range(400 * 12).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") / 12).cast("int").cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 12 + 1).cast("int")).alias("text"))
    made = mixing.decide(docs, weights=(1,), ratio=0.4).collect()
    assert len(made) == 4800 and {round(r.target, 6) for r in made} == {31.2}
    for k in range(12):
        own = [r.copies for r in made if r.id % 12 == k]
        assert abs(sum(own) / 400 - 0.4) < 0.12, k
    by = {}
    for r in made:
        by[r.source] = by.get(r.source, 0) + r["size"] * r.copies
    assert abs(sum(by.values()) / 400 - 31.2) < 0.5 and max(abs(x - 31.2) for x in by.values()) < 6


def plain_mix(units, rate, seed=mixing.SEED):
    """One source's documents [(id, size)], rounded as the docstring words it, pair by pair."""
    import xxhash

    def chain(*values):  # of (value, bytes)
        h = 42
        for v, width in values:
            h = xxhash.xxh64_intdigest((v & ((1 << 8 * width) - 1)).to_bytes(width, "little"), h)
        return h

    share = lambda *values: (chain(*values) >> 11) / float(1 << 53)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    base, rest = int(rate), rate - int(rate)
    todo = sorted(([i, 1, n, n * rest] for i, n in units), key=lambda u: (-u[2], signed(chain((u[0], 8), (1, 4), (seed, 4)))))
    act, done = todo[0], []
    for b in todo[1:]:
        a = act
        a_gap, b_gap = a[2] - a[3], b[2] - b[3]
        up, down = min(a_gap, b[3]), min(a[3], b_gap)
        if share((a[0], 8), (1, 4), (b[0], 8), (1, 4), (seed, 4)) * (up + down) < down:
            if a_gap <= b[3]:
                done.append((a[0], a[2], True))
                act = [*b[:3], b[3] - a_gap]
            else:
                done.append((b[0], b[2], False))
                act = [*a[:3], a[3] + b[3]]
        elif a[3] <= b_gap:
            done.append((a[0], a[2], False))
            act = [*b[:3], b[3] + a[3]]
        else:
            done.append((b[0], b[2], True))
            act = [*a[:3], a[3] - b_gap]
    up = act[3] > 0 and share((act[0], 8), (1, 4), (act[2], 8), (seed, 4)) * act[2] < act[3]
    error = act[2] - act[3] if up else -act[3]
    done.sort(key=lambda d: signed(chain((d[0], 8), (1, 4), (d[1], 8), (seed + 1, 4))))
    every = [(act[0], act[2], up), *done]
    near, few = mixing.NEAR * sum(d[1] for d in every) + 1, [d for d in every if d[1] > 0][: mixing.TURNED]
    turned = set()
    if abs(error) > near:

        def cost(mask):
            left = error
            for k, d in enumerate(few):
                if mask >> k & 1:
                    left += -d[1] if d[2] else d[1]
            own = float(mask.bit_count()) if abs(left) <= near else mixing.TURNED + abs(left)
            return own, signed(chain((act[0], 8), (1, 4), (mask, 4), (seed + 2, 4))), mask

        best = min(map(cost, range(1 << len(few))))[2]
        turned = {d[0] for k, d in enumerate(few) if best >> k & 1}
    return {i: base + (more != (i in turned)) for i, _, more in every}


def test_mix_equals_plain_pivotal_rounding(spark):
    rng = random.Random(19)
    rows = [(100 * s + k, f"s{s:02}", rng.choice([rng.randint(1, 30), rng.randint(1, 900)])) for s in range(9) for k in range(rng.randint(1, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n int").selectExpr("doc_id", "source", "repeat('w ', n) AS text")
    got = mixing.decide(docs).collect()
    for s in {r[1] for r in rows}:
        own = [r for r in got if r.source == s]
        want = plain_mix([(i, n) for i, x, n in rows if x == s], min(2.0, own[0].target / own[0].source_size))
        assert {r.id: r.copies for r in own} == want


def test_mixing_repeated_rows_and_levels(spark):
    texts = ["w " * (1 + i % 9) for i in range(900)]
    docs = table(spark, texts, [i // 3 if i < 600 else i for i in range(900)]).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise("a"))
    made = shared.stored(mixing.decide(docs, block=16), "t")
    rows = made.collect()
    for s in (None, "a"):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= 9
    assert len(rows) == 900
    assert mixing.apply_mix(docs, made).count() == sum(r.copies for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.decide(docs, block=16).collect()))


PAGE = """<html><head><title>T</title></head><body><header>Site name</header><nav><a href=/a>Home</a></nav><div class="cookie-notice">We use cookies</div>
<main><h1>Head &amp; line {0}</h1><p>First <b>bold</b> {0}<br>rest.<p>Second &eacute; {0}.<ul><li>Item</ul><aside>Related</aside><form><input><label>Mail</label></form></main>
<section id="comments"><article class="comment"><p>Nice {0}!</p></article></section><script>var x="</p>";</script><style>p{{}}</style><footer>(c)</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", PAGE.format(i), "x") for i in range(6)]
    rows += [(6, None, None, "x"), (7, "u", "", "x"), (8, "http://h0.com", "plain  text\nonly", "x"), (9, "http://z.com", "<p>cut <b>off &lt;", "x"), (10, "http://h0.com/0", PAGE.format(0), "x"), (11, "http://z.com", "<div>" * 3000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.report(html_text.extract(pages)).collect()}
    for i in range(6):
        assert got[i] == f"Head & line {i}\n\nFirst bold {i} rest.\n\nSecond é {i}.\n\nItem"
    assert got[10] == got[0] and got[6] == got[7] == "" and got[8] == "plain text only" and got[9] == "cut off <" and got[11] == "deep"
    assert html_text.extract(pages.limit(0)).count() == 0


def pages_of(spark, host, bodies):
    return spark.createDataFrame([(i, f"http://{host}/{i}", f"<html><body>{b}</body></html>", "") for i, b in enumerate(bodies)], "page_id long, url string, html string, x string")


def texts_of(pages):
    return {r.page_id: r.text for r in html_text.extract(pages).collect()}


def story(i, n=30):
    return f"story {i} " * n


def test_html_finds_the_slot_of_a_template_without_names(spark):
    """Plain elements only: links, the story, a note within its slot and a line below; classes decide all of it."""
    body = "<div><a href=/>x</a> <a href=/y>y y y</a></div><div><p>{0}</p><p>Send this to a friend.</p><p>more {0}</p></div><div>always the same line</div>"
    pages = pages_of(spark, "one.com", [body.format(story(i)) for i in range(8)])
    want = {i: f"{story(i).strip()}\n\nmore {story(i).strip()}" for i in range(8)}
    assert texts_of(pages) == want
    rows = [r.asDict() for r in html_text.tokens(pages.select(F.lit(1).cast("long").alias("host"), "html")).collect()]
    sets = [frozenset(x) for x in html_text.template(rows)]
    assert html_text.main_text(pages.first().html, *sets) == want[0]
    for i, r in enumerate(rows):  # without occurrence vectors there are no classes, no template and no slot
        r["vector"] = i
    assert html_text.template(rows) == ([], [], []) and "always the same line" in html_text.main_text(pages.first().html)


def test_html_templates_of_several_layouts_and_a_page_that_departs(spark):
    one = "<div class=t><a href=/>home page</a></div><div class=a><div class=b><p>{0}</p></div><div class=s><p>Side {1}</p></div></div><div>Same on all</div>"
    two = "<div class=t><a href=/>home page</a></div><table><tr><td><a href=/1>one</a></td><td><p>{0}</p><p>Print this page</p></td></tr></table><div>Same on all</div>"
    bodies = [one.format(story(i), i) for i in range(9)] + [two.format(story(i)) for i in range(9, 16)]
    bodies.append(one.format(story(16), 16) + "<div class=a><div class=b><p>A second one</p></div></div>")
    bodies += [two.format(story(i)) for i in range(17, 20)]
    got = texts_of(pages_of(spark, "several.com", bodies))
    assert got == {i: story(i).strip() for i in range(20)}


def test_html_block_of_its_own_class_is_no_template(spark):
    """A sentence on most pages, independent of the elements around it, is text; copies of one page stay whole."""
    body = "<div class=t><a href=/>home page</a></div><div class=c><p>{0}</p>{1}</div>"
    bodies = [body.format(story(i), "<p>As said before.</p>" if i % 5 else "") for i in range(15)]
    got = texts_of(pages_of(spark, "said.com", bodies))
    assert got == {i: story(i).strip() + ("\n\nAs said before." if i % 5 else "") for i in range(15)}
    copies = texts_of(pages_of(spark, "copies.com", [body.format(story(1), "<p>Twice.</p>")] * 6))
    assert set(copies.values()) == {story(1).strip() + "\n\nTwice."}


def test_html_equal_siblings_are_taken_together(spark):
    """No part of the text is taken for the whole, and a heading beside the text isn't lost."""
    body = "<div class=c>" + "".join(f"<section><p>{{0}} part {k}</p></section>" for k in range(3)) + "</div>"
    got = texts_of(pages_of(spark, "parts.com", [body.format(story(i)) for i in range(6)]))
    assert got == {i: "\n\n".join(f"{story(i)}part {k}".replace("  ", " ") for k in range(3)) for i in range(6)}
    titled = texts_of(pages_of(spark, "titled.com", [f"<div class=c><h1>Title {i}</h1><div class=d><p>{story(i)}</p></div></div>" for i in range(6)]))
    assert titled == {i: f"Title {i}\n\n{story(i).strip()}" for i in range(6)}


def test_html_hosts_beyond_the_broadcast_bound(spark, monkeypatch):
    body = "<div><a href=/>x y z</a></div><div><p>{0}</p></div>"
    pages = pages_of(spark, "hot.com", [body.format(story(i)) for i in range(40)])
    monkeypatch.setattr(html_text, "BROADCAST_LONGS", 0)
    assert texts_of(pages) == {i: story(i).strip() for i in range(40)}


def test_html_finds_an_article_at_any_depth():
    page = "<body><div class=w>" + "<div>" * 14 + "<div>side one</div><article><header><h1>Title</h1></header><p>Story</p></article><div>side two</div>" + "</div>" * 14 + "</div></body>"
    body = next(e.token for e in html_text.read(page)[0] if e.tag == "body")
    for good in (frozenset(), frozenset([body])):
        assert html_text.main_text(page, good) == "Title\n\nStory"
    deep = "<body>" + "<div>" * 3000 + "<p>one</p>" * 500 + "</body>"
    assert html_text.main_text(deep) == "\n\n".join(["one"] * 500)


def test_html_keeps_formulas_and_embedded_text():
    assert html_text.main_text("<article><p>As <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is</p><object data=x><p>Shown else</p></object></article>") == "As a+b is\n\nShown else"


def test_html_leaves_out_what_is_named_or_hidden(spark):
    parts = ["<div class='siteHeader'>brand</div>", "<div role='search'>find</div>", "<div id='adTop'>buy</div>", "<p hidden>gone</p>", "<div style='display: none'>gone</div>", "<div class='user-comments'><p>me too</p></div>", "<div class='newsletter-signup'>join</div>"]
    body = "<body>" + "".join(parts) + "<article><header><h1>Title</h1></header><p data-x='a>b'>Kept &lt;tag&gt; text</p><div class='share-bar'>share</div></article>" + "".join(parts)
    pages = spark.createDataFrame([(i, f"http://k.com/{i}", body) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(pages).collect()} == {"Title\n\nKept <tag> text"}


def test_null_ids(spark):
    docs = table(spark, ["a b c d e f", "a b c d e f", "g h i", None], [None, 7, 3, 5])
    assert {(r.id, r.class_id, r.n_links) for r in jaccard_join.join(docs).collect()} == {(None, 7, 1), (7, 7, 1), (3, 3, 0), (5, 5, 0)}
    assert {r.doc_id for r in jaccard_join.keep_one(docs, jaccard_join.join(docs)).collect()} == {7, 3, 5}
    follow = {r.doc_id: r.next_doc_id for r in fingerprints.with_next(docs.select("doc_id", "text"), "doc_id", "text", ("doc_id",), range_rows=1).collect()}
    assert follow == {7: 5, 5: 3, 3: None, None: 7}
    assert sorted(r["size"] for r in mixing.decide(docs).collect()) == [0, 3, 6, 6]
    assert docs.select(language.held_out(F.col("doc_id"), 3, 1).alias("h")).filter("h IS NULL").count() == 0
    import public_tokenizers as P

    assert bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 4
    assert licenses.scan(docs).count() == 4 and quality.score(docs, (0.0, [])).count() == 4


def test_hot_source_and_one_document(spark):
    """A third of all rows in one source, and a table of one row."""
    docs = table(spark, [f"w{i} " * (i % 5 + 1) for i in range(300)]).withColumn("source", F.when(F.col("doc_id") < 100, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string"))))
    made = mixing.decide(docs, block=8).collect()
    hot = [r for r in made if r.source == "hot"]
    assert len(made) == 300 and abs(sum(r["size"] * r.copies for r in hot) - hot[0].target) <= 5
    one = mixing.decide(table(spark, ["a b c"])).collect()
    assert len(one) == 1 and one[0].target == 4.5 and one[0].copies in (1, 2)


def test_any_text_is_encoded_like_the_library():
    import public_tokenizers as P
    import tiktoken
    from hypothesis import given, settings
    from hypothesis import strategies as st

    entries, mph, pairs = bpe.vocabulary_of(P.path("byte_bpe_50k.tiktoken"))
    codec = bpe.Codec(entries, P.PATTERN, mph, pairs)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(entries), special_tokens={})

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab 'the\n\t.,!  0é")), max_size=200))
    def same(text):
        ids = codec.encode(text)
        assert ids.tolist() == library.encode_ordinary(text) and codec.decode(ids).decode() == text

    same()


def test_any_markup_is_survived():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    bits = st.sampled_from(["<div class='c'>", "<p>", "</p>", "</div>", "<article>", "</article>", "<ul><li>", "</ul>", "<script>", "</script>", "<!--", "-->", "<a href='x'>", "</a>", "<br>", "<", ">", "&amp;", "&#x;", "text ", "<td>", "<nav>", "</nav>", "<p title=\"", "'", '"'])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(bits, max_size=40).map("".join))
    def survives(page):
        seen = list(html_text.events(page))
        assert sum(k == "open" for k, *_ in seen) == sum(k == "close" for k, *_ in seen)
        elements, blocks = html_text.read(page)
        assert all(0 <= e.first <= e.end <= len(blocks) for e in elements)
        text = html_text.main_text(page, frozenset(e.token for e in elements[1:3]))
        assert all(b and b == " ".join(b.split()) for b in text.split("\n\n")) or text == ""

    survives()
