"""Every registered query against its SQL on the smallest test tables."""

import inspect

import pytest

import __spark_entry__ as driver
from checks.oracles import ORACLES
from checks.queries import QUERIES
from checks.compare import oracle_rows, spark_rows


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, small, name):
    columns, got = spark_rows(spark, small, name)
    want_columns, want = oracle_rows(small, ORACLES[name])
    assert columns == want_columns
    assert got == want


def test_every_query_has_sql_and_takes_the_same_arguments():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
    for query in driver.queries().values():
        assert list(inspect.signature(query).parameters) == ["spark", "sf_dir"]


def test_entry_gives_rows(spark):
    assert driver.entry(spark).count() > 0
