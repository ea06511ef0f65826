import pytest
from conftest import SF
from oracle import compare

from linkloom.llm.oracles import ORACLES
from linkloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SF)
