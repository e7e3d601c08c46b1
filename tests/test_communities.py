"""Communities against exhaustive search, greedy merging and planted groups."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from varve.operators import communities as cm


def _q(edges: dict, label: dict) -> float:
    m = sum(edges.values())
    k: dict = {}
    for (a, b), w in edges.items():
        for c in (label[a], label[b]):
            k[c] = k.get(c, 0) + w
    return sum(w for (a, b), w in edges.items() if label[a] == label[b]) / m - sum(v * v for v in k.values()) / (4 * m * m)


def _best(edges: dict, names: list) -> float:
    """Largest modularity over all partitions."""
    found = -1.0

    def grow(i: int, label: dict, used: int) -> None:
        nonlocal found
        if i == len(names):
            found = max(found, _q(edges, label))
            return
        for c in range(used + 1):
            grow(i + 1, label | {names[i]: c}, max(used, c + 1))

    grow(0, {}, 0)
    return found


def _greedy(edges: dict, names: list) -> float:
    """Modularity of merging the best pair of communities as long as that helps."""
    label = {n: n for n in names}
    reached = _q(edges, label)
    while True:
        pairs = {tuple(sorted((label[a], label[b]))) for a, b in edges if label[a] != label[b]}
        tried = [(_q(edges, {n: (x if c == y else c) for n, c in label.items()}), x, y) for x, y in sorted(pairs)]
        if not tried or max(tried)[0] <= reached + 1e-12:
            return reached
        reached, x, y = max(tried)
        label = {n: (x if c == y else c) for n, c in label.items()}


def _planted(seed: int, groups: int, size: int, inside: float, outside: float) -> dict:
    pick = np.random.default_rng(seed)
    return {(f"n{i:03d}", f"n{j:03d}"): float(round(pick.uniform(0.5, 1), 3)) for i, j in combinations(range(groups * size), 2) if pick.random() < (inside if i // size == j // size else outside)}


def _graphs() -> dict[str, dict]:
    pick = np.random.default_rng(9)
    small = {f"small{s}": {(f"v{i}", f"v{j}"): float(round(pick.uniform(0.1, 1), 3)) for i, j in combinations(range(7), 2) if pick.random() < 0.5} for s in range(3)}
    ring = {(f"c{c}{i}", f"c{c}{j}"): 1.0 for c in range(6) for i, j in combinations(range(4), 2)} | {tuple(sorted((f"c{c}0", f"c{(c + 1) % 6}1"))): 1.0 for c in range(6)}
    star = {("hub", f"leaf{i:02d}"): 1.0 for i in range(30)}
    return small | {"ring": ring, "star": star, "planted": _planted(2, 4, 12, 0.6, 0.05), "noise": _planted(3, 1, 30, 0.2, 0)}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(g, a, b, w) for g, edges in _graphs().items() for (a, b), w in edges.items()]
    edges = spark.createDataFrame(rows, "graph string, src string, dst string, weight double").repartition(7)
    placed = cm.communities(edges)
    labels: dict = {}
    for r in placed.collect():
        labels.setdefault(r.graph, {})[r.node] = r.community
    return edges, placed, labels


def test_modularity_of_all_graphs(found):
    edges, placed, labels = found
    got = {r.graph: r.modularity for r in cm.modularity(edges, placed).collect()}
    for g, known in _graphs().items():
        names = sorted({n for pair in known for n in pair})
        assert sorted(labels[g]) == names
        assert np.isclose(got[g], _q(known, labels[g]))
        reference = _best(known, names) if g.startswith("small") else _greedy(known, names)
        assert got[g] >= 0.99 * reference - 1e-12, g


def test_planted_groups_and_names(found):
    labels = found[2]
    known, groups = _graphs()["planted"], {f"n{i:03d}": i // 12 for i in range(48)}
    assert _q(known, labels["planted"]) >= _q(known, groups) - 1e-12
    assert sum(labels["planted"][f"n{i:03d}"] == labels["planted"][f"n{j:03d}"] for i, j in combinations(range(48), 2) if i // 12 == j // 12) >= 0.9 * 4 * 66
    assert len(set(labels["ring"].values())) == 6 and set(labels["star"].values()) == {"hub"}
    assert all(c == min(n for n, x in own.items() if x == c) for own in labels.values() for c in own.values())


def test_communities_are_connected(found):
    for g, known in _graphs().items():
        label = found[2][g]
        for c in set(label.values()):
            reach, grew = {c}, True
            while grew:
                more = {n for pair in known for n in pair if label[n] == c and (set(pair) & reach)}
                grew, reach = not more <= reach, reach | more
            assert reach == {n for n, x in label.items() if x == c}


def test_dealing_and_empty_tables_change_nothing(spark, found):
    edges, _, labels = found
    again = cm.communities(edges.where("graph in ('planted', 'noise')").coalesce(1)).collect()
    assert {(r.graph, r.node): r.community for r in again} == {(g, n): c for g in ("planted", "noise") for n, c in labels[g].items()}
    odd = spark.createDataFrame([("x", "a", "a", 1.0), ("x", "a", "b", -1.0), ("x", None, "b", 1.0)], "graph string, src string, dst string, weight double")
    assert cm.communities(odd).collect() == []
