"""Every registered query against its SQL."""

import pytest

from ingestctl.catalog import QUERIES
from ingestctl.oracles import ORACLES
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert differences(spark, connection, QUERIES[name], ORACLES[name], SF_DIR) is None
