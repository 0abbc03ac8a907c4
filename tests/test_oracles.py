"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare

from skeingraph.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert not compare(spark, SF, name, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 1


def test_flagship(spark):
    assert registry.flagship(spark, SF).columns == ["anchor", "source", "target", "depth"]
