"""Every core query against its SQL, or at least to its end, on the smallest tables."""

import pytest
from oracle import compare, connect

from weir.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, small, con, name):
    compare(catalog.QUERIES[name](spark, small), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
