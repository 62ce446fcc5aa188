"""Each query with SQL against it, on the smallest tables."""

import pytest

from tests.oracle import connect, same
from tidewatch.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), connect(SF).sql(registry.ORACLES[name]).df())
