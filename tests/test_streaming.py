"""Streams against batch results: shuffled arrival, late rows, restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from varve.operators.staging import Workspace
from varve.streaming import running

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id long, at timestamp, who string, what string, x double"


def _events(n: int) -> list[tuple]:
    pick = random.Random(4)
    return [(i, START + timedelta(minutes=pick.randrange(3000)), pick.choice(["a", "b", None]), pick.choice(["s", "t", None]), float(pick.randrange(9))) for i in range(n)]


def _drop(spark, path: str, rows: list[tuple], name: str) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


@pytest.fixture
def arriving(spark):
    ws = Workspace(spark, "test")
    source = f"{ws.root}/source"
    open_ = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    return source, open_, f"{ws.root}/stream"


def _told(spark, folder: str, keys: list[str]) -> list:
    return running.newest(spark.read.parquet(f"{folder}/told"), keys).collect()


def _switches(rows: list[tuple]) -> dict:
    out = {}
    for who in {r[2] for r in rows}:
        states = [r[3] for r in sorted((r for r in rows if r[2] == who), key=lambda r: (r[1], r[0]))]
        out[who] = len(states), sum(a != b for a, b in zip(states, states[1:]))
    return out


def test_shuffled_arrival_and_restart(spark, arriving):
    source, open_, folder = arriving
    rows = _events(300)
    for k in range(3):
        _drop(spark, source, rows[k * 60 : (k + 1) * 60], f"f{k}")
    stream = lambda: running.switches(open_(), "who", "at", "id", "what", "90 days")
    running.run(stream(), folder)
    assert {r.key: (r.n_rows, r.switches) for r in _told(spark, folder, ["key"])} == _switches(rows[:180])
    _drop(spark, source, rows[180:240], "f3")
    _drop(spark, source, rows[240:], "f4")
    running.run(stream(), folder)  # goes on from the checkpoint
    assert {r.key: (r.n_rows, r.switches) for r in _told(spark, folder, ["key"])} == _switches(rows)


def test_bins(spark, arriving):
    source, open_, folder = arriving
    rows = _events(200)
    for k in range(4):
        _drop(spark, source, rows[k::4], f"f{k}")
    running.run(running.binned(open_(), "at", "1 hour", "90 days", ["who"], "x"), folder)
    want: dict = {}
    for _, at, who, _, x in rows:
        key = int((at - START).total_seconds() // 3600), who
        n, total = want.get(key, (0, 0.0))
        want[key] = n + 1, total + x
    got = {(int((r.bin.replace(tzinfo=timezone.utc) - START).total_seconds() // 3600), r.who): (r.n, r.total) for r in _told(spark, folder, ["bin", "who"])}
    assert got == want


def test_late_rows_go_and_settled_rows_leave_the_state(spark, arriving):
    source, open_, folder = arriving
    at = lambda minutes: START + timedelta(minutes=minutes)
    first = [(1, at(0), "a", "s", 1.0), (2, at(500), "a", "t", 1.0)]
    second = [(3, at(450), "a", "s", 1.0), (4, at(600), "a", "s", 1.0)]  # 450 is within an hour of 500
    third = [(5, at(100), "a", "t", 1.0), (6, at(601), "a", "t", 1.0)]  # 100 is late by then
    stream = lambda: running.switches(open_(), "who", "at", "id", "what", "1 hour")
    for k, rows in enumerate((first, second, third)):
        _drop(spark, source, rows, f"f{k}")
        running.run(stream(), folder)
    (row,) = _told(spark, folder, ["key"])
    assert (row.n_rows, row.switches) == _switches([*first, *second, third[1]])["a"]
