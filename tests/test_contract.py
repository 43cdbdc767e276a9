"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from check_oracle import compare, connect
from contract.registry import queries_by_name
from contract.sql import sql_by_name

FOLDER = os.environ.get("ADLAKE_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(queries_by_name()) == set(sql_by_name())


@pytest.mark.parametrize("name", list(queries_by_name()))
def test_query(spark, con, name):
    state, rows, _, detail = compare(spark, con, name, FOLDER)
    assert state == "ok", detail


def test_entry(spark):
    assert contract.entry(spark).count() > 0
