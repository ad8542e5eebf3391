"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest

from metalith.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(name, spark):
    from .conftest import DATA

    registry.QUERIES[name](spark, DATA).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
