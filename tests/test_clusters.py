"""Silhouettes, chosen k-means and principal components against plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from varve.operators import clusters


def _plain(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = np.zeros(len(x))
    for i in range(len(x)):
        own = (labels == labels[i]) & (np.arange(len(x)) != i)
        others = [far[i, labels == c].mean() for c in set(labels) - {labels[i]}]
        if own.any() and others:
            a, b = far[i, own].mean(), min(others)
            out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return out


@pytest.fixture(scope="module")
def blobs():
    pick = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [6, 0, 1], [0, 7, -2], [5, 6, 4.0]])
    return np.concatenate([c + pick.normal(0, 0.6, (40, 3)) for c in centres])


def _points(spark, x, labels=None):
    rows = [(f"p{i:03d}", v.tolist(), [int(y) for y in (labels[i] if labels is not None else [])]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, z array<double>, labels array<int>").repartition(6)


@pytest.mark.parametrize("block_rows", [17, 1024])
def test_silhouettes_of_several_clusterings(spark, blobs, block_rows):
    pick = np.random.default_rng(5)
    x = np.concatenate([blobs, blobs[:5]])  # equal vectors
    labels = np.stack([pick.integers(0, 3, len(x)), np.repeat(np.arange(5), 33), np.zeros(len(x), dtype=int), np.where(np.arange(len(x)) == 7, 1, 0)], axis=1)
    got = {r.id: r.silhouettes for r in clusters.silhouettes(_points(spark, x, labels), [3, 5, 1, 4], block_rows).collect()}
    want = np.stack([_plain(x, labels[:, c]) for c in range(4)], axis=1)
    assert np.allclose([got[f"p{i:03d}"] for i in range(len(x))], want)


def test_number_of_clusters_is_found(spark, blobs):
    rows, table = clusters.chosen_k_means(_points(spark, blobs).select("id", "z"))
    rows, scores = rows.collect(), {r.k: r.silhouette for r in table.collect()}
    assert {r.n_clusters for r in rows} == {4} and scores[4] == max(scores.values())
    labels = np.array([r.cluster for r in sorted(rows, key=lambda r: r.id)])
    assert all(len(set(labels[i : i + 40])) == 1 for i in range(0, 160, 40)) and len(set(labels)) == 4
    assert np.isclose(rows[0].mean_silhouette, _plain(blobs, labels).mean())


def test_few_points(spark, blobs):
    rows, table = clusters.chosen_k_means(_points(spark, blobs[:2]).select("id", "z"))
    assert [(r.cluster, r.silhouette, r.n_clusters) for r in rows.collect()] == [(0, None, 1)] * 2 and table.collect() == []
    rows, _ = clusters.chosen_k_means(_points(spark, blobs[:3]).select("id", "z"))
    assert {r.n_clusters for r in rows.collect()} == {2}
    assert clusters.chosen_k_means(_points(spark, blobs[:2]).select("id", "z").limit(0))[0].collect() == []


def test_components(spark, blobs):
    found, explained = clusters.components(_points(spark, blobs), 2)
    x = blobs - blobs.mean(0)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    v = v[:2] * np.sign(v[np.arange(2), np.abs(v[:2]).argmax(1)])[:, None]
    got = np.array([r.scores for r in sorted(found.collect(), key=lambda r: r.id)])
    assert np.allclose(got, x @ v.T) and np.allclose(explained, (s**2 / (s**2).sum())[:2])
    assert clusters.components(_points(spark, blobs).limit(0))[0].collect() == []
