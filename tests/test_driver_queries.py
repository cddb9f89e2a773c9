import pytest

import __spark_entry__ as entry
from codexmill.plans import driver

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query_agrees_with_its_sql(spark, agrees, name):
    assert agrees(driver.QUERIES[name](spark, DATA), driver.ORACLES[name]) > 0


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(driver.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
