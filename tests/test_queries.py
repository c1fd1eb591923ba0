"""Every query of the catalog runs on the smallest tables and gives what its SQL gives."""

import pytest

from skein.plans import catalog
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, sf, con, name):
    assert_same(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
