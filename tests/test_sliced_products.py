"""Products of few long rows: a slice of labels per task instead of ever more pairs of blocks."""

from __future__ import annotations

import numpy as np

from varve.operators import blocks
from varve.operators.staging import Workspace
from varve.plans import link_queries
from varve.sources.domain import CORES, Domain


def test_products_over_slices(spark, monkeypatch):
    pick = np.random.default_rng(4)
    rows, want = [], {}
    for core in ("A", "B"):
        x = {f"n{i}": {int(k): float(pick.normal()) for k in pick.choice(300, 200, replace=False)} for i in range(5)}
        x["alone"] = {1000: 1.0}
        rows += [(core, n, sorted(v), [v[k] for k in sorted(v)]) for n, v in x.items()]
        for a in x:
            for b in x:
                shared = x[a].keys() & x[b].keys()
                if a < b and len(shared) >= 8:
                    want[core, a, b] = (len(shared), sum(x[a][k] * x[b][k] for k in shared))
    stored = Workspace(spark, "test").table(spark.createDataFrame(rows, "core string, node string, labels array<long>, x array<double>"), "rows")
    monkeypatch.setattr(blocks, "by_blocks", None)  # whole rows meet in no task
    got = {(r.core, r.src, r.dst): (r.n, r.r) for r in blocks.products(stored, 8, block_values=600).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and np.isclose(got[k][1], r) for k, (n, r) in want.items())
    some = blocks.products(stored, 8, 3.0, block_values=600).collect()
    assert {(r.core, r.src, r.dst) for r in some} == {k for k, (_, r) in want.items() if abs(r) >= 3}


def test_link_queries_read_stored_log_ratios(spark, sf, monkeypatch):
    seen = []
    plain = link_queries.nodes
    monkeypatch.setattr(link_queries, "nodes", lambda d, *rest: seen.append(d.clr_primary) or plain(d, *rest))
    assert link_queries.link_holdout(Domain(spark, sf)).columns[0] == "core"
    assert len(seen) == len(CORES) and all("log-ratios" in f for rows in seen for f in rows.inputFiles())
    assert sorted(seen[0].collect()) == sorted(Domain(spark, sf).clr_primary.select(seen[0].columns).collect())
