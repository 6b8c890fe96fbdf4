"""Every query against its SQL, on the smallest tables."""

import pytest

from tests.compare import connect, differences
from tests.conftest import SMALL
from trackloom.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SMALL) == []


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
