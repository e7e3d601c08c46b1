"""Operators on small inputs with known results, empty tables and nulls."""

from __future__ import annotations

import math

import numpy as np

from varve.operators.components import connected_components
from varve.operators.graphs import aracne, page_rank, path_measures
from varve.plans.statistics_queries import exponential_gls

EDGES = "core string, src string, dst string, signed_weight double, weight double"


def test_components(spark):
    rows = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 1), (2, 1), *[(100 + i, 101 + i) for i in range(40)]]
    found = dict(map(tuple, connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()))
    want = {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5} | {100 + i: 100 for i in range(41)}
    assert found == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_aracne_drops_the_weakest_edge_of_a_triangle(spark):
    e = spark.createDataFrame([("c", "a", "b", 0.9, 0.9), ("c", "b", "d", 0.8, 0.8), ("c", "a", "d", 0.5, 0.5), ("k", "a", "d", 0.5, 0.5)], EDGES)
    assert {(r.core, r.src, r.dst) for r in aracne(e).collect()} == {("c", "a", "b"), ("c", "b", "d"), ("k", "a", "d")}


def test_path_measures_of_a_path(spark):
    e = spark.createDataFrame([("c", "a", "b", 0.5, 0.5), ("c", "b", "d", 0.5, 0.5)], EDGES)
    got = {r.taxon: r for r in path_measures(e).collect()}
    assert math.isclose(got["b"].betweenness, 1.0) and got["a"].betweenness == 0
    assert math.isclose(got["b"].closeness, 2.0) and math.isclose(got["a"].efficiency, (2 + 1) / 2)


def test_page_rank_sums_to_one(spark):
    e = spark.createDataFrame([("c", "a", "b", 0.5, 0.5), ("c", "b", "d", 0.5, 0.5)], EDGES)
    got = {r.taxon: r.rank for r in page_rank(e).collect()}
    assert math.isclose(sum(got.values()), 1.0) and got["b"] > got["a"] == got["d"]


def test_gls_equals_one_fit_over_all_cores(spark):
    """The stacked model with a column per core and block-diagonal errors, at the phi that was chosen and at all others."""
    rng = np.random.default_rng(3)
    rows = [("t", c, float(x), float(0.5 * x + k + e), float(a)) for k, c in enumerate("ABC") for a, (x, e) in enumerate(rng.normal(size=(9, 2)))]
    rows += [("flat", "A", 1.0, float(a), float(a)) for a in range(6)] + [("one", "A", 1.0, 2.0, 3.0), ("t", "A", None, 1.0, 1.0)]
    found = {r["taxon"]: r for r in exponential_gls(spark.createDataFrame(rows, "taxon string, core string, x double, y double, age double")).collect()}
    assert found["flat"]["slope"] is None and found["one"]["slope"] is None and found["one"]["n"] == 1
    used = [r for r in rows if r[0] == "t" and r[2] is not None]
    core, x, y, age = (np.array([r[i] for r in used]) for i in (1, 2, 3, 4))
    design = np.column_stack([x, *[(core == c).astype(float) for c in "ABC"]])
    fits = []
    for phi in np.linspace(0, 0.95, 20):
        v = np.where(core[:, None] == core[None, :], np.power(phi, np.abs(age[:, None] - age[None, :])), 0.0) + 1e-8 * np.eye(len(x))
        inverse = np.linalg.inv(v)
        cov = np.linalg.inv(design.T @ inverse @ design)
        beta = cov @ design.T @ inverse @ y
        rss = (y - design @ beta) @ inverse @ (y - design @ beta)
        fits.append((-len(x) / 2 * np.log(rss) - np.linalg.slogdet(v)[1] / 2, phi, beta[0], np.sqrt(rss / (len(x) - 4) * cov[0, 0])))
    _, phi, slope, se = max(fits)
    assert np.allclose([found["t"][k] for k in ("phi", "slope", "se", "t")], [phi, slope, se, slope / se], rtol=1e-5)


def test_gls_of_a_long_core_needs_no_square_of_it(spark):
    """Equal and very near ages, a phi of the grid and all others, against whitening by the whole matrix; then 20,000 rows of a core."""
    import tracemalloc

    import pandas as pd

    from varve.plans import statistics_queries as sq

    pick = np.random.default_rng(8)

    def table(n, taxa):
        age = np.round(pick.uniform(0, 150, n), 3)
        age[: n // 10] = age[n // 10 : 2 * (n // 10)]
        return pd.concat([pd.DataFrame({"taxon": f"t{i}", "age": age, "x": 3 + pick.normal(size=n), "y": pick.normal(size=n)})[: n - 3 * i] for i in range(taxa)])

    small = table(60, 3).sample(frac=1, random_state=1)
    got = sq._gls_terms(small).set_index(["taxon", "phi"])
    for taxon, part in small.groupby("taxon"):
        far = np.abs(part.age.to_numpy()[:, None] - part.age.to_numpy()[None, :])
        for phi in sq._PHIS:
            low = np.linalg.cholesky((np.power(phi, far) if phi else np.eye(len(part))) + 1e-8 * np.eye(len(part)))
            one, a, b = np.linalg.solve(low, np.column_stack([np.ones(len(part)), part.x, part.y])).T
            a, b = a - one * (one @ a) / (one @ one), b - one * (one @ b) / (one @ one)
            want = [len(part), a @ a, a @ b, b @ b, np.log(np.diag(low)).sum()]
            assert np.allclose(got.loc[(taxon, phi)].to_numpy(float), want, rtol=1e-5), (taxon, phi)
    large = table(20_000, 1)
    tracemalloc.start()
    assert (sq._gls_terms(large).n == 20_000).all()
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
