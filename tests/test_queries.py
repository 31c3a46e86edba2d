from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from bindings.common import ORACLES, QUERIES, SCHEMAS
from oracle import connect, difference

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

# No order falls on the moment of the snapshot at the smallest scale.
MAY_BE_EMPTY = {"snapshot"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    found = difference(spark, FOLDER, con, QUERIES[name], ORACLES[name])
    if found == "both empty" and name in MAY_BE_EMPTY:
        return
    assert found is None


def test_entry_returns_the_curve(spark):
    assert entry.entry(spark).count() == 11


def test_schemas_are_those_of_the_files(spark):
    for table, schema in SCHEMAS.items():
        found = spark.read.parquet(f"{FOLDER}/{table}.parquet").schema
        assert spark.read.schema(schema).parquet(f"{FOLDER}/{table}.parquet").schema == found
