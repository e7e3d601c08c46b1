"""Switches whose keys share states: as many groups as given, whatever the number of keys, and every key by itself."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from varve.operators.staging import Workspace
from varve.plans import stream_queries
from varve.sources.domain import Domain
from varve.streaming import running

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LAST = START + timedelta(days=9999)


def _want(rows: list[tuple]) -> dict:
    out = {}
    for who in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == who), key=lambda r: (r[1] or LAST, r[0] is None, r[0] or 0))
        out[who] = len(mine), sum(a[3] != b[3] for a, b in zip(mine, mine[1:]))
    return out


def _stream(spark, source: str, kind: str):
    return spark.readStream.schema(f"id long, at timestamp, who {kind}, what string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)


def _drop(spark, source: str, name: str, rows: list[tuple], kind: str) -> None:
    spark.createDataFrame(rows, f"id long, at timestamp, who {kind}, what string").coalesce(1).write.parquet(f"{source}/{name}")


def test_calls_do_not_grow_with_the_keys(spark):
    ws = Workspace(spark, "test")
    source, folder = f"{ws.root}/source", f"{ws.root}/stream"
    rows = [(i, START + timedelta(minutes=i % 7), i % 2000, "st"[i // 2000]) for i in range(4000)]
    _drop(spark, source, "f", rows, "long")
    found = running.switches(_stream(spark, source, "long"), "who", "at", "id", "what", "90 days")
    query = found.writeStream.outputMode("update").option("checkpointLocation", folder).format("noop").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 1025


@pytest.mark.parametrize(("kind", "groups"), [("long", 3), ("string", 1)])
def test_keys_of_a_group_stay_apart_while_rows_settle(spark, kind, groups):
    """Files overlap in time by less than the delay, so rows settle in the state but none is late; ids beyond 2**53, nulls everywhere."""
    ws = Workspace(spark, "test")
    source, folder = f"{ws.root}/source", f"{ws.root}/stream"
    pick, rows = random.Random(groups), []
    name = {"long": lambda k: 2**60 + k, "string": lambda k: f"u{k}"}[kind]
    for f in range(3):
        part = []
        for _ in range(120):
            # Users come and go: some begin late, some have no rows in later files.
            user = pick.choice([None, *range(3 * f, 3 * f + 9)])
            at = None if pick.random() < 0.03 else START + timedelta(minutes=100 * f + pick.randrange(150))
            part.append((pick.choice([None, 2**60 + pick.randrange(10**6)]), at, None if user is None else name(user), None if user == 20 else pick.choice(["s", "t", "", None])))
        # A key must not hold two equal rows by time and id with other states: their order would be open.
        part = [r for r in {(r[1], r[0], r[2]): r for r in (*part, *rows)}.values() if r not in rows]
        rows += part
        _drop(spark, source, f"f{f}", part, kind)
        running.run(running.switches(_stream(spark, source, kind), "who", "at", "id", "what", "1 hour", groups), folder)  # goes on from the checkpoint
        told = running.newest(spark.read.parquet(f"{folder}/told"), ["key"]).collect()
        assert {r.key: (r.n_rows, r.switches) for r in told} == _want(rows)
    kept = spark.read.format("statestore").load(f"{folder}/checkpoint").select("value.groupState.rows").collect()
    assert len(kept) <= groups + 1
    waiting, newest = sum(len(running._unpacked(r.rows)) for r in kept), max(r[1] for r in rows if r[1])
    assert waiting == sum(r[1] is None or r[1] > newest - timedelta(hours=1) for r in rows)


def test_triggers_do_not_grow_with_the_files(spark, sf, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILES", 30)
    ws = Workspace(spark, "test")
    events, folder = stream_queries._arriving(Domain(spark, sf), ws), f"{ws.root}/stream"
    running.run(running.binned(events, "at", "6 hours", "400 days", ["event_type"], "value"), folder)
    told = spark.read.parquet(f"{folder}/told")
    assert told.select("batch").distinct().count() <= stream_queries.TRIGGERS + 1
    assert sum(r.n for r in running.newest(told, ["bin", "event_type"]).collect()) == Domain(spark, sf).table("events").count()
