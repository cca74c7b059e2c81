"""Every query of the catalogue against its oracle."""

from __future__ import annotations

import pytest
from helpers import same

from millrace import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_oracle(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert name in registry.ORACLES
    same(df, registry.ORACLES[name], sf)


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
