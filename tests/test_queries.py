"""Every registered query beside its SQL on the smallest tables."""

import pytest
from conftest import SF_DIR
from oracle import compare, connect

from docledger.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    assert compare(spark, connection, name, QUERIES[name], ORACLES[name], SF_DIR) == ""
