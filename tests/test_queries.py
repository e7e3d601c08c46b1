"""Every query of the library against its SQL twin on the smallest tables; those without one must run and keep their schema."""

from __future__ import annotations

import comparing
import pytest

from varve.plans import registry

WITHOUT_TWIN = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.fixture(scope="module")
def con(sf):
    return comparing.duck(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, sf, con, name):
    assert comparing.difference(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", WITHOUT_TWIN)
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert all(set(r.asDict()) == set(df.columns) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0
