"""Every registered query of the base engine against its DuckDB twin, on the smallest tables."""

import pytest
from oracle import assert_same

from murmuration.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_sql(spark, name):
    assert_same(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_an_oracle(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
