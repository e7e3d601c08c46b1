"""Side-by-side comparison of a query and its SQL twin, as unordered rows with columns by name."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x: object) -> object:
    if isinstance(x, bool):
        return x
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if x != x else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_cell(v) for v in x)
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the rows agree, else what differs first."""
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    left, right = rows_of(df.columns, df.collect()), rows_of(names, want.fetchall())
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    return next((f"{a} and {b}" for a, b in zip(left, right) if a != b), "")
