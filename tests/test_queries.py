import pytest
import support

from loomgraph import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(name, spark, sf, duck):
    support.same(catalogue.QUERIES[name](spark, sf), catalogue.ORACLES[name], duck)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() >= 0
