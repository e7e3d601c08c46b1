"""Soft modules against a dense NumPy loop, planted groups, and SQL on the stored assignment."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from varve.operators import soft_modules as sm
from varve.operators.staging import Workspace

GRAPHS, SIZE, K = ["p", "q", "r"], 18, 4
COUPLINGS = [("p", "q", 0.5), ("q", "r", 0.2)]


def _planted(seed: int):
    """Three graphs over the same names with three groups of six, some nodes missing."""
    pick = np.random.default_rng(seed)
    nodes, edges = [], []
    for g in GRAPHS:
        there = [i for i in range(SIZE) if pick.random() < 0.9]
        nodes += [(g, f"n{i:02d}") for i in there]
        edges += [(g, f"n{i:02d}", f"n{j:02d}", float(round(pick.uniform(0.6, 1), 3))) for i in there for j in there if i < j and pick.random() < (0.9 if i // 6 == j // 6 else 0.05)]
    return nodes, edges


def _start(spark, names):
    start = spark.createDataFrame([(n,) for n in names], "node string")
    rows = start.select("node", *[((0.5 + sm._hashed(sm.F.lit("soft"), sm.F.col("node"), sm.F.lit(i))) / K**0.5).alias(f"v{i}") for i in range(K)]).collect()
    return {r[0]: np.array(r[1:]) for r in rows}


def _loop(nodes, edges, start, rounds):
    """The same updates with dense matrices; the objective straight from its definition."""
    names = {g: [n for h, n in nodes if h == g] for g in GRAPHS}
    a = {g: np.eye(len(names[g])) for g in GRAPHS}
    for g, x, y, w in edges:
        i, j = names[g].index(x), names[g].index(y)
        a[g][i, j] += w
        a[g][j, i] += w
    s = {g: np.array([start[n] for n in names[g]]) for g in GRAPHS}

    def objective():
        total = sum(((a[g] - s[g] @ s[g].T) ** 2).sum() for g in GRAPHS)
        for g, h, c in COUPLINGS:
            total += sum(c * ((s[g][names[g].index(n)] - s[h][names[h].index(n)]) ** 2).sum() for n in names[g] if n in names[h])
        return total

    reached = [objective()]
    for _ in range(rounds):
        new = {}
        for g in GRAPHS:
            up, down = 2 * a[g] @ s[g], 2 * s[g] @ (s[g].T @ s[g])
            for x, y, c in COUPLINGS:
                other = y if x == g else x if y == g else None
                for i, n in enumerate(names[g]):
                    if other and n in names[other]:
                        up[i] += c * s[other][names[other].index(n)]
                        down[i] += c * s[g][i]
            new[g] = s[g] * (up / down) ** 0.25
        s = new
        reached.append(objective())
    return {(g, n): s[g][i] for g in GRAPHS for i, n in enumerate(names[g])}, reached


@pytest.fixture(scope="module")
def fitted(spark):
    nodes, edges = _planted(5)
    ws = Workspace(spark, "test-soft")
    state, reached = sm.fit(spark.createDataFrame(nodes + nodes[:3], "graph string, node string"), spark.createDataFrame(edges, "graph string, a string, b string, weight double"), K, COUPLINGS, 12, ws)
    return nodes, edges, ws.table(sm.memberships(state), "assigned"), {(r.graph, r.node): np.array(r.s) for r in state.collect()}, reached


def test_equal_to_dense_loop(spark, fitted):
    nodes, edges, _, found, reached = fitted
    want, objectives = _loop(nodes, edges, _start(spark, sorted({n for _, n in nodes})), 12)
    assert set(found) == set(want)
    assert all(np.allclose(found[k], want[k], rtol=1e-9) for k in want)
    assert np.allclose(reached, objectives, rtol=1e-9)


def test_objective_never_rises(fitted):
    reached = fitted[4]
    assert all(b <= a + 1e-9 for a, b in zip(reached, reached[1:])) and reached[-1] < 0.8 * reached[0]


def test_entropy_and_argmax_equal_sql(fitted):
    assigned = fitted[2]
    con = duckdb.connect()
    con.register("a", assigned.toPandas())
    long = "SELECT graph, node, unnest(probability) AS p, unnest(range(1, len(probability)+1)) AS k FROM a"
    want = con.execute(
        f"""WITH l AS ({long}), e AS (SELECT node, avg(h) AS h, count(*) AS n FROM (SELECT graph, node, -sum(p*ln(p+1e-12)) AS h FROM l GROUP BY ALL) GROUP BY node),
        v AS (SELECT node, k, round(avg(p),12) AS p FROM l GROUP BY ALL), m AS (SELECT node, k FROM v QUALIFY row_number() OVER (PARTITION BY node ORDER BY p DESC, k)=1) SELECT node, k, h, n FROM m JOIN e USING (node)"""
    ).fetchall()
    found = {r.node: r for r in sm.consensus(assigned, K).collect()}
    assert len(found) == len(want)
    for node, k, h, n in want:
        assert found[node].module == k and found[node].n_graphs == n and abs(found[node].mean_entropy - h) < 1e-12


def test_planted_groups_share_a_module(spark):
    nodes, edges = _planted(8)
    state, _ = sm.fit(spark.createDataFrame(nodes, "graph string, node string"), spark.createDataFrame(edges, "graph string, a string, b string, weight double"), K, COUPLINGS, 60)
    found = {r.node: r.module for r in sm.consensus(sm.memberships(state), K).collect()}
    groups = [[found[n] for n in sorted(found) if int(n[1:]) // 6 == g] for g in range(3)]
    agreeing = sum(max(g.count(m) for m in g) for g in groups)
    assert agreeing >= 0.85 * len(found) and len({max(set(g), key=g.count) for g in groups}) == 3


def test_pooled_graph(spark, fitted):
    nodes, edges, assigned, _, _ = fitted
    rows = {(r.graph, r.node): np.array(r.probability) for r in assigned.collect()}
    want = {g: np.zeros((K, K)) for g in GRAPHS}
    for g, a, b, w in edges:
        want[g] += w * (np.outer(rows[g, a], rows[g, b]) + np.outer(rows[g, b], rows[g, a]))
    for r in sm.pooled(assigned, spark.createDataFrame(edges, "graph string, a string, b string, weight double"), K).collect():
        assert abs(r.weight - want[r.graph][int(r.a[1:]) - 1, int(r.b[1:]) - 1] / want[r.graph].max()) < 1e-9


def test_empty_and_lonely(spark):
    no_edges = spark.createDataFrame([], "graph string, a string, b string, weight double")
    state, reached = sm.fit(spark.createDataFrame([], "graph string, node string"), no_edges, K, COUPLINGS, 2)
    assert state.count() == 0 and reached == [0.0, 0.0, 0.0]
    state, reached = sm.fit(spark.createDataFrame([("p", "x"), (None, "y"), ("p", None)], "graph string, node string"), no_edges, K, [], 30)
    assert state.count() == 1 and abs(sum(v * v for v in state.first().s) - 1) < 1e-3 and reached[-1] < 1e-5
