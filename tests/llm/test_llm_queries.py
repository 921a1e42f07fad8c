"""The registered queries: against SQL where there is SQL, else against brute force or held-out rows."""

import hashlib
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

from compare import by_sql, rows
from gleaner.llm import registry
from gleaner.llm.bpe import read_ranks
from llm.helpers import near_pairs, union_find


def documents(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_match_sql(spark, small, name):
    mine, theirs = registry.QUERIES[name](spark, small).toPandas(), by_sql(registry.ORACLES[name], small)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_language_on_held_out_rows(spark, small):
    truth = {d: lang for d, _, lang, _ in documents(small)}
    got = registry.QUERIES["op2_language"](spark, small).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_quality_on_held_out_rows(spark, small):
    small = small.replace("sf0.001", "sf0.01")  # the smallest tables have too few labels to learn from
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{small}/labels.parquet'").fetchall())
    got = registry.QUERIES["op7_quality"](spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_pages_give_their_article(spark, small):
    import html

    want = {}
    for page, source in duckdb.sql(f"SELECT page_id, html FROM '{small}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want[page] = "\n\n".join(b for b in blocks if b)
    got = registry.QUERIES["op4_html_text"](spark, small).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_fingerprints_of_edited_texts(spark, small):
    docs = documents(small)[::-1]
    got = {r.doc_id: r for r in registry.QUERIES["op5_fingerprints"](spark, small).collect()}
    by_text = {}
    for k, (d, text, *_) in enumerate(docs):
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[(k + 1) % len(docs)][1][:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(text)
        assert by_text.setdefault(text, got[d].fingerprint) == got[d].fingerprint
    assert sum(r.near_edited > r.near_next for r in got.values()) / len(got) > 0.9


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_joined_classes_and_links(spark, small, scale):
    small = small.replace("sf0.001", scale)
    docs = documents(small)
    pairs = near_pairs([t for _, t, *_ in docs])
    root = union_find(len(docs), pairs)
    links = [0] * len(docs)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    got = {r.doc_id: (r.class_id, r.n_links) for r in registry.QUERIES["op8_jaccard_join"](spark, small).collect()}
    assert got == {docs[k][0]: (docs[root[k]][0], links[k]) for k in range(len(docs))}


def test_tokens_equal_the_library(spark, small):
    ranks = dict(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in registry.QUERIES["op9_byte_bpe"](spark, small).collect()}
    for d, text, *_ in documents(small):
        ids = library.encode_ordinary(text)
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_mix_comes_near_its_targets(spark, small):
    source = {d: s for d, _, _, s in documents(small)}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, *_ in documents(small)}
    totals = {}
    for d, s in source.items():
        totals[s] = totals.get(s, 0) + size[d]
    names = sorted(totals)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(totals.values())
    while True:  # by rounds, as the contract words it
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 2 * totals[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * totals[s]
            left -= want[s]
        free -= over
    want |= {s: weight[s] * share for s in free}
    got = registry.QUERIES["op10_mixing"](spark, small).collect()
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == totals[s] and r.target == pytest.approx(want[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(size) and all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 20 for s in names)
    assert sorted(got) == sorted(registry.QUERIES["op10_mixing"](spark, small).collect())


def test_pipeline_keeps_clean_documents_once_a_group(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = [docs]
    for name, stage in p.STAGES[:-1]:
        steps.append(p.stored(stage(spark, steps[-1], small), "test"))
        assert steps[-1].columns == docs.columns, name
    quality, exact, near, mixed = ([(r.doc_id, r.text) for r in s.orderBy("doc_id").collect()] for s in steps[1:])
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for d, t in quality:
        best[strip(t)] = min(best.get(strip(t), (0, 0)), (-len(t), d)) if strip(t) in best else (-len(t), d)
    assert [d for d, _ in exact] == sorted(d for _, d in best.values())
    root = union_find(len(exact), near_pairs([t for _, t in exact]))
    assert near == [exact[k] for k in range(len(exact)) if root[k] == k]
    assert {d for d, _ in mixed} <= {d for d, _ in near}
    out = p.run(spark, small)
    assert out.count() == len(mixed) and {r.doc_id for r in out.collect()} == {d for d, _ in mixed}


def test_pipeline_stages_on_odd_tables(spark, small):
    """Nulls, empty and long texts, repeated rows, an empty table and columns with names that stages use themselves."""
    import corpus_pipeline as p

    base = spark.read.parquet(f"{small}/documents.parquet")
    texts = [None, "", "  ", "one two three four five six", "one two three four five six", "One two three\nfour five six", "w " * 30_000, "plain words of a clean sentence here. " * 20]
    rows = [(i if i < 7 else None, t, None if i % 3 == 0 else "en", None if i % 2 else "s", len(t or ""), f"mine {i}", "x") for i, t in enumerate([*texts, texts[3]])]
    odd = spark.createDataFrame(rows, f"{base._jdf.schema().toDDL().replace('`', '')}, `__key` string, size string")
    for docs in (odd, odd.limit(0)):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, small)
            got = out.collect()
            assert out.columns == docs.columns, name
            assert all(r["__key"].startswith("mine") and r["size"] == "x" for r in got) and (docs is odd or not got), name
        assert p.STAGES[-1][1](spark, docs, small).count() == docs.count()
    kept = p.drop_copies(spark, odd, small).collect()
    assert sorted(len(r.text or "") for r in kept) == [2, 27, 27, 760, 60_000]
    near = p.drop_near_copies(spark, odd, small).collect()
    assert len(near) == 4 and {r.doc_id for r in near} == {0, 3, 6, None}
