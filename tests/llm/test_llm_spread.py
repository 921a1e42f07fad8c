"""How large nodes are split: tokens of their classes are counted within tasks."""

from collections import Counter

import numpy as np
import pytest

from gleaner.llm import jaccard_join as J


@pytest.mark.parametrize("held", [3, 1 << 17])
def test_agreement_is_counted_within_tasks(spark, monkeypatch, held):
    monkeypatch.setattr(J, "HELD", held)
    rng, runs = np.random.default_rng(4), 4
    rows = [(node, n, rng.choice([0, 0, 7, -3, 2**62], runs).tolist()) for node, n in ((5, 40), (-9, 25), (6, 1)) for _ in range(n)]
    level = spark.createDataFrame(rows, "node long, n long, path array<long>").repartition(3)
    spread = J._spread(level, runs)
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for each function of each class
    got = {r.node: (r.alike, [(x.s, x.r) for x in r.order]) for r in spread.collect()}
    for node, n in ((5, 40), (-9, 25)):
        paths = [p for k, _, p in rows if k == node]
        s = {r: sum(c * c for t, c in Counter(p[r] for p in paths).items() if t) / n**2 for r in range(runs)}
        assert got[node][0] == pytest.approx(sum(s.values()) / runs)
        assert got[node][1] == [(pytest.approx(x), r) for x, r in sorted((x, r) for r, x in s.items())]
    one = list(J._chosen_in_nodes(iter(level.coalesce(1).toArrow().to_batches())))
    if held > 66:
        assert sum(b.num_rows for b in one) <= 3 * 3 * runs  # nodes, tokens, functions: not rows a class
