"""Link prediction against plain NumPy, planted links, and the scans over sorted rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import links, ordered


def _numpy_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps on |w|^2 / 2 + sum of balanced losses, intercept last and free; x is standardised."""
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    a = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(ridge + (a * (weight * p * (1 - p))[:, None]).T @ a, ridge @ w + a.T @ (weight * (p - y)))
    return w


def _quality(labels: list[int], scores: list[float]) -> tuple[float, float]:
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap = last = 0.0
    for cut in sorted(set(scores), reverse=True):
        hit = sum(p >= cut for p in pos)
        ap += (hit / len(pos) - last) * hit / (hit + sum(n >= cut for n in neg))
        last = hit / len(pos)
    return auc, ap


@pytest.fixture(scope="module")
def planted(spark):
    """Two groups of nodes with vectors around two directions; most edges lie inside a group."""
    pick = np.random.default_rng(4)
    rows = []
    for i in range(60):
        z = (np.array([1.0, 0, 0, 0.5]) if i % 2 else np.array([0, 1.0, 0.5, 0])) + pick.normal(0, 0.3, 4)
        rows.append((f"n{i:02d}", z.tolist(), [float(v) for v in pick.integers(0, 2, 3)]))
    edges = {(rows[i][0], rows[j][0]) for i in range(60) for j in range(i + 1, 60) if pick.random() < (0.85 if (i - j) % 2 == 0 else 0.02)}
    nodes = spark.createDataFrame(rows, "node string, z array<double>, sites array<double>")
    return nodes, spark.createDataFrame(sorted(edges), "a string, b string"), {r[0]: r for r in rows}, edges


def _features(a, b) -> list[float]:
    (z1, s1), (z2, s2) = (map(np.array, r[1:]) for r in (a, b))
    return [float(z1 @ z2 / max(np.linalg.norm(z1) * np.linalg.norm(z2), 1e-12)), float(s1 @ s2), min(s1.sum(), s2.sum()), max(s1.sum(), s2.sum())]


@pytest.mark.parametrize("block_rows", [7, 512])
def test_absent_pairs_and_features_by_blocks(planted, block_rows):
    nodes, observed, known, edges = planted
    got = {(r.a, r.b): list(r)[2:6] for r in links.absent_by_blocks(nodes, observed, block_rows=block_rows).collect()}
    names = sorted(known)
    assert set(got) == {(a, b) for a in names for b in names if a < b} - edges
    assert all(np.allclose(v, _features(known[a], known[b])) for (a, b), v in got.items())


def test_fit_and_measures_equal_numpy(spark, planted):
    nodes, observed, known, edges = planted
    absent = links.sample_absent(nodes, observed, len(edges))
    pairs = observed.withColumn("label", F.lit(1)).unionByName(absent.withColumn("label", F.lit(0)))
    rows = links.pair_features(pairs, nodes)
    local = rows.collect()
    x, y = np.array([_features(known[r.a], known[r.b]) for r in local]), np.array([r.label for r in local])
    model = links.fit(rows, links.FEATURES)
    scaled = (x - x.mean(0)) / x.std(0)
    assert np.allclose([*model.weights, model.intercept], _numpy_fit(scaled, y), atol=1e-6)
    scores = (1 / (1 + np.exp(-model.logit(x)))).tolist()
    quality = ordered.ranking_quality(rows.select("label", model.score(links.FEATURES).alias("score"))).first()
    assert np.allclose([quality.auc, quality.average_precision], _quality(y.tolist(), scores))


def test_planted_links_are_found(spark, planted):
    from varve.operators.staging import Workspace
    from varve.plans.link_queries import predicted_links

    nodes, observed, known, edges = planted
    found = predicted_links(nodes, observed, Workspace(spark, "test")).collect()
    assert found[0].holdout_auc > 0.75 and found[0].holdout_ap > 0.75
    assert [r.rank for r in sorted(found, key=lambda r: (-r.score, r.a, r.b))] == list(range(1, len(known) * (len(known) - 1) // 2 - len(edges) + 1))
    best = [r for r in found if r.rank <= 50]
    assert sum((int(r.a[1:]) - int(r.b[1:])) % 2 == 0 for r in best) > 45


def test_samples_of_absent_pairs(spark, planted):
    nodes, observed, known, edges = planted
    names = sorted(known)
    absent = {(a, b) for a in names for b in names if a < b} - edges
    few = [tuple(r) for r in links.sample_absent(nodes, observed, 50).collect()]
    assert len(few) == len(set(few)) == 50 and set(few) <= absent
    assert few == [tuple(r) for r in links.sample_absent(nodes.repartition(5), observed.repartition(3), 50).collect()]
    assert {tuple(r) for r in links.sample_absent(nodes, observed, 10_000).collect()} == absent  # fewer than twice as many: all are listed
    assert links.sample_absent(nodes, observed, 0).collect() == []


def test_no_edges_and_no_nodes(spark, planted):
    from varve.operators.staging import Workspace
    from varve.plans.link_queries import predicted_links

    nodes, observed, _, _ = planted
    assert predicted_links(nodes, observed.limit(0), Workspace(spark, "test")).collect() == []
    assert predicted_links(nodes.limit(0), observed.limit(0), Workspace(spark, "test")).collect() == []
    with pytest.raises(ValueError):
        links.fit(spark.createDataFrame([(1, 0.5)], "label int, x double"), ["x"])


def test_running_sums_at_any_partitioning(spark):
    pick = random.Random(2)
    rows = [(pick.choice(["a", "b", None]), i, pick.choice([None, 1, 2, 5])) for i in range(500)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, k int, v int").repartition(parts, "k")
        got = {r.k: (r.total, r.position) for r in ordered.positions(ordered.running_sums(df, [F.desc("k")], {"total": F.col("v")}, ["g"]), [F.col("k")]).collect()}
        for g in ("a", "b", None):
            total = 0
            for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]):
                total += v or 0
                assert got[k] == (total, k)
