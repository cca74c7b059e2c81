"""Queries with SQL against it."""

from __future__ import annotations

import pytest
from helpers import same

from millrace.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
