"""Resampled correlations, module stability and preservation against loops over replicates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import resampling as rs

CORES, TAXA = {"A": 14, "B": 11, "tiny": 4}, [f"t{i:02d}" for i in range(24)]


@pytest.fixture(scope="module")
def data(spark):
    pick = np.random.default_rng(1)
    x = {c: pick.normal(0, 1, (len(TAXA), n)) + np.repeat(pick.normal(0, 1.5, (4, n)), 6, axis=0) for c, n in CORES.items()}
    x["B"][3] = 2.0  # does not vary
    rows = [(c, k, t, float(x[c][i, k])) for c, n in CORES.items() for i, t in enumerate(TAXA) for k in range(n)]
    return spark.createDataFrame(rows, "core string, label long, taxon string, clr double").repartition(5), x


def _loop(x: dict, replicates: int, cutoff: float) -> dict:
    """Correlations of every replicate by repeating the samples drawn."""
    out = {}
    for core in ("A", "B"):
        n = CORES[core]
        for replicate in range(replicates + 1):
            drawn = np.repeat(np.arange(n), rs.multiplicities(core, n, replicate).astype(int))
            sample = x[core][:, drawn]
            for i in range(len(TAXA)):
                for j in range(i + 1, len(TAXA)):
                    if sample[i].std() > 1e-12 and sample[j].std() > 1e-12:
                        r = np.corrcoef(sample[i], sample[j])[0, 1]
                        if abs(r) >= cutoff:
                            out[core, replicate, TAXA[i], TAXA[j]] = r
    return out


@pytest.mark.parametrize("block_values", [1 << 22, 150])
def test_edges_of_all_replicates(data, block_values):
    clr, x = data
    got = {(r.core, r.replicate, r.src, r.dst): r.r for r in rs.resampled_edges(clr, 4, 0.6, 8, block_values).collect()}
    want = _loop(x, 4, 0.6)
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_best_matches_by_hand(spark):
    rows = [("A", 0, n, "a") for n in "abcd"] + [("A", 0, n, "x") for n in "xy"] + [("A", 1, n, "b") for n in "bcd"] + [("A", 1, n, "x") for n in "xyz"] + [("A", 2, n, "q") for n in "qr"]
    modules = spark.createDataFrame(rows, "core string, replicate int, node string, module string")
    found = {(r.module, r.replicate): (r.matched, round(r.jaccard, 6), r.size, r.matched_size) for r in rs.best_matches(modules, 2, 2).collect()}
    assert found == {("a", 1): ("b", 0.75, 4, 3), ("x", 1): ("x", 0.666667, 2, 3), ("a", 2): (None, 0.0, 4, 0), ("x", 2): (None, 0.0, 2, 0)}
    assert rs.best_matches(modules.limit(0), 2).collect() == []


@pytest.mark.parametrize("block_values", [1 << 22, 400])
def test_preservation_equals_a_loop(spark, data, block_values):
    clr, x = data
    modules = spark.createDataFrame([(t, f"m{i // 6}") for i, t in enumerate(TAXA)], "node string, module string")
    labels = {r.node: r.labels for r in rs.permuted_labels(modules, 6).collect()}
    assert all(sorted(labels[t][p] for t in TAXA) == sorted(f"m{i // 6}" for i in range(24)) for p in range(7))
    assert [labels[t][0] for t in TAXA] == [f"m{i // 6}" for i in range(24)] != [labels[t][1] for t in TAXA]
    with np.errstate(divide="ignore", invalid="ignore"):
        here, there = np.corrcoef(x["B"]), np.corrcoef(x["A"])
    got = {r.module: r for r in rs.preservation(clr.where("core <> 'tiny'"), modules, "A", 6, block_values).collect()}
    for module in ("m0", "m1", "m2", "m3"):
        stats = []
        for p in range(7):
            own = [i for i, t in enumerate(TAXA) if labels[t][p] == module and i != 3]
            pairs = [(i, j) for a, i in enumerate(own) for j in own[a + 1 :]]
            h, t = np.array([here[q] for q in pairs]), np.array([there[q] for q in pairs])
            stats.append((h.mean(), np.corrcoef(h, t)[0, 1]))
        stats = np.array(stats)
        z = (stats[0] - stats[1:].mean(0)) / stats[1:].std(0, ddof=1)
        r = got[module]
        assert np.allclose([r.density, r.connectivity, r.z_density, r.z_connectivity, r.z_summary], [*stats[0], *z, z.mean()])
    assert got["m2"].z_density > 2  # planted to hold together


def test_empty(data):
    clr, _ = data
    assert rs.resampled_edges(clr.limit(0), 3).collect() == []
    assert rs.linked_modules(rs.resampled_edges(clr.where(F.lit(False)), 3)).collect() == []
