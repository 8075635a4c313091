"""Every registered query against its SQL."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    assert differences(spark, db, FOLDER, queries()[name], oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 30
