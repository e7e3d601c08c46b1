"""Sweeps: what is computed, used again, failed, and computed again."""

from __future__ import annotations

import pytest

from varve.operators.staging import Workspace
from varve.operators.sweeps import Combination, Sweep, same_parameters


@pytest.fixture
def setting(spark):
    ws = Workspace(spark, "test")
    source = f"{ws.root}/source"
    spark.range(10).write.parquet(source)
    calls = []

    def build(parameters: dict):
        calls.append(parameters["keep"])
        if parameters["keep"] < 0:
            raise ValueError("nothing to keep\nmore lines")
        return spark.read.parquet(source).where(f"id < {parameters['keep']}")

    return spark, Sweep(spark, f"{ws.root}/sweep"), source, build, calls


def _status(table) -> dict:
    return {r.name: (r.status, r.n_rows) for r in table.collect()}


def test_second_run_computes_nothing_and_a_change_one(setting):
    spark, sweep, source, build, calls = setting
    grid = [Combination(f"c{k}", {"keep": k, "cut": k / 3}) for k in (2, 3, 4)]
    assert _status(sweep.run(grid, build, [source])) == {"c2": ("computed", 2), "c3": ("computed", 3), "c4": ("computed", 4)}
    near = [Combination(c.name, c.parameters | {"cut": c.parameters["cut"] + 1e-12}) for c in grid]
    assert set(_status(Sweep(spark, sweep.folder).run(near, build, [source])).values()) == {("reused", 2), ("reused", 3), ("reused", 4)} and calls == [2, 3, 4]
    changed = [Combination("c2", {"keep": 5, "cut": 2 / 3}), *grid[1:]]
    assert _status(sweep.run(changed, build, [source])) == {"c2": ("computed", 5), "c3": ("reused", 3), "c4": ("reused", 4)}
    assert calls == [2, 3, 4, 5] and sweep.result("c2").count() == 5 and sweep.manifest().count() == 9


def test_failures_stay_apart_and_keep_older_results(setting):
    spark, sweep, source, build, calls = setting
    sweep.run([Combination("a", {"keep": 3})], build, [source])
    found = sweep.run([Combination("a", {"keep": -1}), Combination("b", {"keep": 1})], build, [source])
    assert _status(found) == {"a": ("failed", None), "b": ("computed", 1)} and sweep.result("a").count() == 3
    assert found.where("name = 'a'").first().message == "ValueError: nothing to keep"
    assert _status(sweep.run([Combination("a", {"keep": 3})], build, [source])) == {"a": ("computed", 3)}  # the newest entry is a failure


def test_changed_inputs_missing_files_and_force(setting):
    spark, sweep, source, build, calls = setting
    one = [Combination("a", {"keep": 30})]
    sweep.run(one, build, [source])
    spark.range(10, 20).write.mode("append").parquet(source)
    assert _status(sweep.run(one, build, [source])) == {"a": ("computed", 20)}
    assert _status(sweep.run(one, build, [source])) == {"a": ("reused", 20)}
    assert _status(sweep.run(one, build, [source], force=True)) == {"a": ("computed", 20)}
    path, files = sweep._path("results/a/_SUCCESS")
    files.delete(path, False)
    assert _status(sweep.run(one, build, [source])) == {"a": ("computed", 20)} and len(calls) == 4


def test_parameters():
    assert same_parameters({"a": [1, 2.0], "b": {"c": "x"}}, {"a": [1, 2.0 + 1e-10], "b": {"c": "x"}})
    assert not same_parameters({"a": 1}, {"a": True}) and not same_parameters({"a": 1.0}, {"a": 1.1}) and not same_parameters({"a": 1}, {"b": 1})
