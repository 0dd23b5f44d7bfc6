"""Every registered query agrees with its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check
from assetlake.suite import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    verdict, _, rows = check.compare(spark, duck, name, FOLDER)
    assert verdict in ("ok", "rows only")
    assert rows > 0 or name == "next_task"


def test_entry(spark):
    assert entry.entry(spark).count() == 5
