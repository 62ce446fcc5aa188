"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from tidewatch.plans import registry

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), db.sql(registry.ORACLES[name]).df())
