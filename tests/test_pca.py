"""Components from sums of products against a decomposition of the whole matrix."""

from __future__ import annotations

import numpy as np

from varve.plans.statistics_queries import gram_pca


def test_components_equal_those_of_the_whole_matrix(spark):
    pick = np.random.default_rng(5)
    tables = {3: pick.normal(size=(40, 6)) * [5, 3, 2, 1, 1, 1] + 4, 5: pick.normal(size=(2, 4)), 9: pick.normal(size=(1, 3))}
    rows = [(t, e, f"f{j}", float(v)) for t, x in tables.items() for e, line in enumerate(x) for j, v in enumerate(line)]
    found = gram_pca(spark.createDataFrame(rows, "threshold int, entity long, feature string, x double").repartition(5), "threshold")
    # The matrix of a group went into one task before.
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.threshold, r.entity, r.component): (r.score, r.explained) for r in found.collect()}
    assert len(got) == 40 * 3 + 2 * 2 + 1
    for t, x in tables.items():
        u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        for c in range(min(3, len(s))):
            sign = np.sign(vt[c, np.abs(vt[c]).argmax()])
            for e in range(len(x)):
                score, explained = got[t, e, c + 1]
                assert abs(score - u[e, c] * s[c] * sign) < 1e-6 and abs(explained - s[c] ** 2 / max((s**2).sum(), 1e-300)) < 1e-9
    assert gram_pca(spark.createDataFrame([], "threshold int, entity long, feature string, x double"), "threshold").count() == 0
