"""Every named query beside its SQL on the smallest tables."""

import pytest
import side_by_side as sbs

from ledgerloom import plans
from ledgerloom.plans import registry

plans.load()


@pytest.fixture(scope="module")
def con(small):
    return sbs.connect(small)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, small, con, name):
    got = sbs.spark_rows(registry.QUERIES[name](spark, small))
    assert name in registry.ORACLES
    assert sbs.differences(got, sbs.sql_rows(con, registry.ORACLES[name])) is None
