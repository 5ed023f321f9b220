import pytest
from oracle import compare, connect

from weir.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, small, name):
    compare(catalog.QUERIES[name](spark, small), connect(small), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
