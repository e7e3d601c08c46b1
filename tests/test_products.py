"""Best products of sparse vectors against all pairs, and term vectors against the rows of tf_idf."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import products
from varve.operators.staging import Workspace
from varve.plans import retrieval
from varve.sources.domain import Domain


def _vectors(seed: int, n: int) -> dict:
    """Vectors of a few of 400 ids, id 0 in nearly all; every seventh equals the one before."""
    pick, out = np.random.default_rng(seed), {}
    for key in range(n):
        ids = sorted({int(i) for i in pick.zipf(1.3, 9) if i < 400} | ({0} if key % 11 else set()))
        out[key] = dict(zip(ids, pick.exponential(0.2, len(ids)).tolist())) if key % 7 or not key else out[key - 1]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize(("block_values", "step_values", "dense"), [(1 << 22, 1 << 22, 0.01), (700, 300, 0.01), (700, 5000, 2.0), (700, 300, -1.0)])
def test_equal_to_all_pairs(spark, monkeypatch, block_values, step_values, dense):
    rows, asked = _vectors(1, 300), {q: v for q, v in _vectors(1, 300).items() if q % 20 == 0} | {1000: {12345: 1.0}}
    left = products.pa.table({"k": list(rows), "ids": [list(v) for v in rows.values()], "weights": [list(v.values()) for v in rows.values()]})
    monkeypatch.setattr(products, "STEP_VALUES", step_values)
    monkeypatch.setattr(products, "DENSE_SHARE", dense)
    # In this process, where the settings hold.
    a = products._Vectors(left, "k")
    right = products._Vectors(products.pa.table({"k": list(asked), "ids": [list(v) for v in asked.values()], "weights": [list(v.values()) for v in asked.values()]}), "k")
    found = products.scores(products._ByTerm(right.ids, right.at, right.weights), len(asked), products._ByTerm(a.ids, a.at, a.weights), len(rows))
    want = np.array([[sum(w * rows[d].get(t, 0.0) for t, w in asked[q].items()) for d in sorted(rows)] for q in sorted(asked)])
    assert np.allclose(found, want, rtol=1e-12, atol=1e-15)
    # On Spark, by blocks.
    ws = Workspace(spark, "test-products")
    kinds = "{} long, ids array<long>, weights array<double>"
    table = lambda v, key: ws.table(spark.createDataFrame([(k, list(x), list(x.values())) for k, x in v.items()], kinds.format(key)).repartition(3), key)
    got = defaultdict(list)
    for r in products.top_products(table(rows, "doc"), table(asked, "query_id"), 5, block_values=block_values).collect():
        got[r.query_id].append((-r.score, r.doc))
    best = {q: sorted((-round(s, 6), d) for s, d in zip(want[i], sorted(rows)) if s > 0)[:5] for i, q in enumerate(sorted(asked))}
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in best.items() if v}


def test_term_vectors_hold_the_weights_of_asked_terms(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = F.col("doc_id") % 20 == 0
    weights = retrieval.tf_idf(docs, "doc_id", "text")
    asked = weights.where(wanted).select("term").distinct()
    want = weights.join(asked, "term", "left_semi").select("doc_id", F.xxhash64("term").alias("id"), F.round("weight", 9).alias("w"))
    got = retrieval.term_vectors(docs, "doc_id", "text", wanted).select("doc_id", F.explode(F.arrays_zip("ids", "weights")).alias("v"))
    got = got.select("doc_id", F.col("v.ids").alias("id"), F.round("v.weights", 9).alias("w"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_search_makes_no_row_per_product(spark, sf):
    plan = retrieval.semantic_search(Domain(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan, plan
