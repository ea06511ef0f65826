import pytest
from conftest import SF
from oracle import compare

from linkloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF)
