"""Nearest rows of a block against a plain sort, with equal similarities, and the memory it takes."""

from __future__ import annotations

import tracemalloc

import numpy as np

from varve.plans.knowledge import best_of_block


def test_the_best_of_a_block():
    pick = np.random.default_rng(2)
    matrix = np.round(pick.normal(size=(300, 3)))  # many ties
    matrix /= np.maximum(np.sqrt((matrix**2).sum(1, keepdims=True)), 1e-12)
    ids = pick.permutation(300)
    asked = np.concatenate([ids[:40], [900]])
    wanted = np.concatenate([matrix[:40], matrix[:1]])
    for k, values in ((5, 1), (5, 900), (400, 1 << 22)):
        got = best_of_block(ids, matrix, asked, wanted, k, values)
        for q, v in zip(asked, wanted):
            want = sorted((-round(float(s), 6), i) for i, s in zip(ids, matrix @ v) if i != q)[:k]
            rows = got[got.query_id == q]
            assert list(rows.neighbour_id) == [i for _, i in want] and np.allclose(rows.similarity, [-s for s, _ in want])


def test_memory_of_a_full_block():
    pick = np.random.default_rng(3)
    matrix, n = pick.normal(size=(20_000, 8)), 4000
    tracemalloc.start()
    assert len(best_of_block(np.arange(20_000), matrix, np.arange(n), matrix[:n], 5)) == 5 * n
    assert tracemalloc.get_traced_memory()[1] < 200e6  # 4000 x 20000 similarities are 640 MB
    tracemalloc.stop()
