"""Every query with SQL equals its SQL on the smallest tables."""

import os

import pytest

from meterloom.plans.catalog import ORACLES, QUERIES
from tests.compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    same_names, found, expected, diff, names = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert same_names, names
    assert found == expected, diff


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
