import pytest

import __spark_entry__ as entry_point
from checks import compare
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_names_match():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in entry_point.oracle_sql():
        assert compare.difference(spark, con, FOLDER, name) is None
    else:
        assert entry_point.queries()[name](spark, FOLDER).count() > 0
