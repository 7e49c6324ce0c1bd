"""Every registered query against its checking SQL, on the smallest data set."""

import pytest

from stewardry.plans import registry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_checks_belong_to_queries():
    assert set(registry.CHECKS) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    query = registry.QUERIES[name]
    if name in registry.CHECKS:
        assert compare(spark, con, query, registry.CHECKS[name], SF) is None
    else:
        assert query(spark, SF).limit(1).count() == 1
