"""Every query that has SQL returns the rows of its SQL; the library doesn't need its optional part."""

import subprocess
import sys
from pathlib import Path

import pytest

from compare import by_sql, rows
from gleaner import catalog

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_match_sql(spark, small, name):
    mine, theirs = catalog.QUERIES[name](spark, small).toPandas(), by_sql(catalog.ORACLES[name], small)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_library_stands_alone():
    code = "import sys, gleaner.catalog; assert not any(m.startswith('gleaner.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query", "id", "score", "path", "source_class", "chars", "position"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_whole_graph_is_searched(spark, small):
    kinds = {r.kind for r in catalog.QUERIES["graph_edges"](spark, small).select("kind").distinct().collect()}
    assert {"has_part", "supplied_by"} <= kinds
    found = {r.subject: r.id for r in catalog.QUERIES["subject_resolution"](spark, small).filter("state = 'resolved'").collect()}
    assert found["Customer#000000001"] == "node:customer:shop:1" and found["supplier 3"] == "node:supplier:shop:3"
    assert {"supplier 3", "customer#00000002"} <= {r.subject for r in catalog.QUERIES["did_you_mean"](spark, small).collect()}
