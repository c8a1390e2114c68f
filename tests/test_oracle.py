"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle_check

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    status, n, _, note = oracle_check.compare(spark, con, name, QUERIES[name], ORACLE.get(name), FOLDER)
    if status == "EMPTY":  # nothing to compare on the smallest tables
        status, n, _, note = oracle_check.compare(spark, oracle_check.connect(LARGER), name, QUERIES[name], ORACLE.get(name), LARGER)
    assert status in ("ok", "rows-only"), f"{status} {note}"  # an empty result proves nothing


def test_registry():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["hotel_name", "room_type_name", "current_price", "checkin_date", "checkout_date"]
