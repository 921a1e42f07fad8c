"""The graph of files after changes in any order against one built anew."""

import random

import pytest

from gleaner import graph_index
from gleaner.operators import code

NAMES = [f"pkg/m{i}" for i in range(6)]


def content(rng, path):
    other = lambda: rng.choice(NAMES).split("/")[1]
    if path.endswith(".py"):
        return f"import pkg.{other()}\nfrom pkg.{other()} import x\ndef run():\n    pass\n"
    if path.endswith(".go"):
        return f'package pkg\nimport "app/pkg/{other()}"\nfunc Run() {{}}\n'
    return f"See `pkg/{other()}.py` and [it](pkg/{other()}.go).\n"


def every_path():
    return [n + e for n in NAMES for e in (".py", ".go", "_test.go", "/__init__.py")] + [f"docs/n{i}.md" for i in range(4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_changes_gives_the_graph_of_a_build(spark, tmp_path, seed):
    rng, state = random.Random(seed), {}
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string")
    names = lambda rows: spark.createDataFrame([(p,) for p in rows], "path string")
    state |= {p: content(rng, p) for p in rng.sample(every_path(), 8)}
    g = graph_index.build(f"file://{tmp_path}/grown", frame(list(state.items())))
    for step in range(4):
        removed = rng.sample(sorted(state), min(len(state), 3 + 6 * (step == 2)))
        changed = {p: content(rng, p) for p in rng.sample([p for p in every_path() if p not in removed], 7)}
        state = {p: c for p, c in state.items() if p not in removed} | changed
        g = graph_index.change(g, frame(list(changed.items())), names(removed))
        fresh = graph_index.build(f"file://{tmp_path}/fresh{step}", frame(list(state.items())))
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(g.links()) == rows(fresh.links()) and rows(g.table("paths")) == rows(fresh.table("paths"))
        assert rows(g.table("nodes").select("id", "kind", "key", "name", "path")) == rows(fresh.table("nodes").select("id", "kind", "key", "name", "path"))
        there = {r.id for r in g.table("nodes").collect()}
        edges = g.table("edges").collect()
        assert len({e.id for e in edges}) == len(edges) and all(e.stale == (e.dst not in there) for e in edges)
    again = graph_index.change(graph_index.GraphIndex(spark, g.path, g.segment - 1), frame(list(changed.items())), names(removed))
    assert rows(again.links()) == rows(g.links())  # a change that is made again replaces itself
    assert rows(graph_index.copied(g, f"file://{tmp_path}/copy").links()) == rows(g.links())


def test_files_without_references(spark, tmp_path):
    files = spark.createDataFrame([("a.txt", "nothing")], "path string, content string")
    g = graph_index.build(f"file://{tmp_path}/few", files)
    assert g.links().count() == 0 and g.table("wanted").count() == 0
    g = graph_index.change(g, spark.createDataFrame([("b.md", "see `a.txt`")], "path string, content string"), files.select("path").limit(0))
    assert [r.kind for r in g.links().collect()] == ["doc_mentions_file"]
    g = graph_index.change(g, files.limit(0), files.select("path"))
    assert g.links().count() == 0 and g.table("edges").filter("stale").count() == 1


def test_only_buckets_of_moved_paths_are_read(spark, tmp_path):
    rows = [(f"pkg/f{i}.py", f"import pkg.g{i}\n") for i in range(60)]
    g = graph_index.build(f"file://{tmp_path}/b", spark.createDataFrame(rows, "path string, content string"))
    files = spark.createDataFrame([("pkg/g7.py", "x = 1\n")], "path string, content string")
    again = graph_index.again_resolved(g, files.select("path"), files.select("path"))
    assert [r.path for r in again.collect()] == ["pkg/f7.py"]


def test_settings_of_any_length_keep_their_parents(spark):
    text = "root:\n" + "".join(f"  k{i}: {i}\n" for i in range(5000)) + "after: 1\nlist:\n  - a: 1\n"
    keys = {r.key for r in code.config_keys(spark.createDataFrame([("c.yaml", text)], "path string, content string")).collect()}
    assert {f"root.k{i}" for i in range(5000)} | {"root", "after", "list"} <= keys and "k4999" not in keys
