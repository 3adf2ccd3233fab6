"""Every registered query against its SQL on the second engine, over the whole smallest tables."""

import pytest

import __spark_entry__ as entry
from gaugeframe.plans.catalog import ORACLES, QUERIES
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    _, rows, same, note = compare(spark, con, FOLDER, name, QUERIES, ORACLES)
    assert same, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r["recall_low"] <= r["recall"] <= r["recall_high"] <= 1 for r in rows if r["recall"] is not None)
