"""Every registered measurement query against its SQL on the smallest tables."""

import pytest

from probelake.queries import ORACLES, QUERIES
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    assert name in ORACLES
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) == ([], [])


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
