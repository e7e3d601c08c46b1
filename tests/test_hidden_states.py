"""Hidden Markov models in chunks against plain loops over whole sequences."""

from __future__ import annotations

import numpy as np
import pytest

from varve.operators import hidden_states as hs
from varve.operators.staging import Workspace

MODEL = hs.Hmm(np.array([0.6, 0.3, 0.1]), np.array([[0.8, 0.15, 0.05], [0.1, 0.85, 0.05], [0.2, 0.0, 0.8]]), np.array([[0.0, 1.0], [2.0, -1.0], [-2.0, 0.5]]), np.array([[1.0, 0.5], [0.6, 1.2], [0.4, 0.8]]))


def _sequences(seed: int, lengths: dict[str, int]) -> dict[str, np.ndarray]:
    pick = np.random.default_rng(seed)
    out = {}
    for name, n in lengths.items():
        state, rows = pick.choice(3, p=MODEL.start), []
        for _ in range(n):
            rows.append(MODEL.mean[state] + pick.normal(0, np.sqrt(MODEL.var[state])))
            state = pick.choice(3, p=MODEL.move[state])
        out[name] = np.array(rows)
    return out


def _plain(x: np.ndarray, m: hs.Hmm):
    """Log likelihood, shares of states, expected moves and the best path of one sequence."""
    density = np.exp(-0.5 * ((x[:, None, :] - m.mean) ** 2 / m.var + np.log(2 * np.pi * m.var)).sum(-1))
    n, k = density.shape
    a, c = np.zeros((n, k)), np.zeros(n)
    for t in range(n):
        a[t] = (m.start if t == 0 else a[t - 1] @ m.move) * density[t]
        c[t] = a[t].sum()
        a[t] /= c[t]
    b = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (density[t + 1] * b[t + 1]) / c[t + 1]
    moved = sum((np.outer(a[t - 1], density[t] * b[t]) * m.move / c[t] for t in range(1, n)), np.zeros((k, k)))
    with np.errstate(divide="ignore"):
        best, move = np.log(m.start) + np.log(density[0]), np.log(m.move)
    back = []
    for t in range(1, n):
        back.append((best[:, None] + move).argmax(0))
        best = (best[:, None] + move).max(0) + np.log(density[t])
    path = [int(best.argmax())]
    for row in reversed(back):
        path.append(int(row[path[-1]]))
    return np.log(c).sum(), a * b, moved, path[::-1]


def _frame(spark, sequences):
    rows = [(s, i, *map(float, v)) for s, x in sequences.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "core string, t long, u double, v double").repartition(5)


@pytest.fixture(scope="module")
def sequences():
    return _sequences(1, {"a": 150, "b": 1, "c": 37, "d": 300})


@pytest.mark.parametrize("length,fan", [(1000, 64), (16, 64), (4, 3)])
def test_likelihood_counts_and_path_at_any_chunk_size(spark, sequences, monkeypatch, length, fan):
    monkeypatch.setattr(hs, "FAN", fan)
    ws = Workspace(spark, "test")
    chunks = hs.chunked(_frame(spark, sequences), "core", ["t"], ["u", "v"], length, ws)
    plain = {s: _plain(x, MODEL) for s, x in sequences.items()}
    (sums,) = hs.expectation(chunks, [MODEL], ws)
    shares = np.concatenate([p[1] for p in plain.values()])
    x = np.concatenate(list(sequences.values()))
    want = np.concatenate(
        [[sum(p[0] for p in plain.values())], sum(p[1][0] for p in plain.values()), sum(p[2] for p in plain.values()).ravel(), shares.sum(0), (shares.T @ x).ravel(), (shares.T @ x**2).ravel()]
    )
    assert np.allclose(sums, want, rtol=1e-9, atol=1e-9)
    got = hs.decode(chunks, MODEL, ws).collect()
    for s, (_, share, _, path) in plain.items():
        rows = sorted((r for r in got if r.sequence == s), key=lambda r: r.key)
        assert [r.state - 1 for r in rows] == path
        assert np.allclose([r.posterior for r in rows], share[np.arange(len(path)), path])


def test_fit_finds_the_planted_states(spark):
    ws = Workspace(spark, "test")
    chunks = hs.chunked(_frame(spark, _sequences(2, {"a": 400, "b": 300})), "core", ["t"], ["u", "v"], 64, ws)
    fitted = hs.fit(chunks, [m for k in (2, 3) for m in hs.starts(chunks, k, 3, 2)], 40, 1e-6, ws)
    two, three = max(f[1] for f in fitted[:3]), max(fitted[3:], key=lambda f: f[1])
    assert three[1] > two + 50
    order = np.argsort(three[0].mean[:, 0])
    assert np.allclose(three[0].mean[order], MODEL.mean[np.argsort(MODEL.mean[:, 0])], atol=0.25)
    assert np.allclose(three[1], hs.log_likelihood(chunks, [three[0]], ws)[0], rtol=1e-4)


def test_likelihood_never_falls(spark, sequences):
    ws = Workspace(spark, "test")
    chunks = hs.chunked(_frame(spark, sequences), "core", ["t"], ["u", "v"], 50, ws)
    model, seen = hs.starts(chunks, 3, 1, 2)[0], []
    for _ in range(6):
        (sums,) = hs.expectation(chunks, [model], ws)
        seen.append(sums[0])
        model = hs.maximisation(sums, model, np.full(2, 1e-9))
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))


def test_nulls_and_empty(spark):
    ws = Workspace(spark, "test")
    rows = spark.createDataFrame([("a", 1, 0.5, 1.0), (None, 2, 0.1, 0.2), ("a", 3, None, 1.0)], "core string, t long, u double, v double")
    chunks = hs.chunked(rows, "core", ["t"], ["u", "v"], 8, ws)
    assert hs.decode(chunks, MODEL, ws).count() == 2
    assert hs.decode(hs.chunked(rows.limit(0), "core", ["t"], ["u", "v"], 8, ws), MODEL, ws).collect() == []
