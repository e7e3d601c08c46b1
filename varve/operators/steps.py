"""Steps in a fixed order, each from the stored tables of the steps before it; a run may start in the middle."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def step_id(given: str) -> str:
    """``3``, ``03`` and ``003`` are ``03``; letters after the number stay; anything else stays as it is."""
    found = re.fullmatch(r"0*(\d+)([A-Za-z]*)", given)
    return f"{int(found[1]):02d}{found[2]}" if found else given


@dataclass(frozen=True)
class Step:
    """``build`` gets the tables of all earlier steps by their id."""

    id: str
    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]


def run(spark: SparkSession, steps: list[Step], folder: str, start: str | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str, str]]]:
    """The tables by step, stored below ``folder``, and ``(id, name, state)`` with state ``reused`` before ``start`` and ``computed`` from it on.

    An unknown ``start``, an earlier step without a stored table, and two steps of one id raise before anything is computed.
    """
    ids = [step_id(s.id) for s in steps]
    if len(set(ids)) != len(ids):
        raise ValueError("two steps have the same id")
    first = 0 if start is None else ids.index(step_id(start)) if step_id(start) in ids else -1
    if first < 0:
        raise ValueError(f"no step {start}; known: {', '.join(ids)}")
    tables: dict[str, DataFrame] = {}
    for i in range(first):
        try:
            tables[ids[i]] = spark.read.parquet(f"{folder}/{ids[i]}")
        except AnalysisException as missing:
            raise ValueError(f"step {ids[i]} has no stored table; start there") from missing
    for i in range(first, len(steps)):
        path = f"{folder}/{ids[i]}"
        steps[i].build(dict(tables)).write.mode("overwrite").parquet(path)
        tables[ids[i]] = spark.read.parquet(path)
    return tables, [(ids[i], s.name, "reused" if i < first else "computed") for i, s in enumerate(steps)]
