"""Queries of the subpackage against their SQL twins on the smallest tables."""

from __future__ import annotations

import comparing
import pytest

from varve.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, sf, name):
    assert comparing.difference(queries.QUERIES[name](spark, sf), comparing.duck(sf), queries.ORACLES[name]) == ""
