from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.operators import reconcile as op
from helpers import rows

KEYS = ["ba", "t"]


@pytest.fixture
def total(spark):
    data = [("A", 1, 10.0), ("A", 2, 20.0), ("B", 1, 30.0), ("C", 1, 40.0), (None, 1, 50.0)]
    return spark.createDataFrame(data, "ba string, t int, total double")


@pytest.fixture
def parts(spark):
    data = [
        ("A", 1, "x", 4.0), ("A", 1, "y", 6.0), ("A", 2, "x", None), ("A", 2, "y", None),
        ("B", 3, "x", 1.0), (None, 1, "x", 9.0), ("D", 1, "x", 2.0),
    ]
    return spark.createDataFrame(data, "ba string, t int, source string, part double")


def test_reconcile_matches_on_keys_and_sums_nulls_to_zero(total, parts):
    found = rows(op.reconcile(total, parts, KEYS, "total", "part"))
    assert found == [("A", 1, 10.0, 10.0), ("A", 2, 20.0, 0.0)]


def test_complete_grid_fills_absent_combinations_only(total, parts):
    found = rows(op.reconcile(total, parts, KEYS, "total", "part", complete_grid=True))
    # B is in the parts and so is hour 1, though not together; C is not in the parts.
    assert found == [("A", 1, 10.0, 10.0), ("A", 2, 20.0, 0.0), ("B", 1, 30.0, 0.0)]


def test_complete_grid_counts_values_seen_beside_a_null_key(spark):
    total = spark.createDataFrame([("A", 5, 1.0)], "ba string, t int, total double")
    parts = spark.createDataFrame(
        [("A", 1, 1.0), (None, 5, 2.0)], "ba string, t int, part double"
    )
    found = rows(op.reconcile(total, parts, KEYS, "total", "part", complete_grid=True))
    assert found == [("A", 5, 1.0, 0.0)]


def test_sum_of_parts_does_not_depend_on_partitioning(parts):
    one = rows(op.sum_of_parts(parts.coalesce(1), KEYS, "part"))
    many = rows(op.sum_of_parts(parts.repartition(7), KEYS, "part"))
    assert one == many


def test_shared_keys_and_shared_reconcile(total, parts):
    assert rows(op.shared_keys(total, parts, KEYS)) == [("A", 1), ("A", 2)]
    assert rows(op.reconcile(total, parts, KEYS, "total", "part")) == [
        ("A", 1, 10.0, 10.0), ("A", 2, 20.0, 0.0)
    ]


def test_identity_check_keeps_null_measures_and_drops_null_labels(spark):
    data = [("A", 5.0, 9.0, 4.0), ("A", None, 9.0, None), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "ba string, d double, g double, i double")
    found = rows(op.identity_check(df, "d", "g", "i", "ba"))
    assert found == [("A", None, None), ("A", 5.0, 5.0)]


def test_series_extract_includes_both_midnights(spark):
    stamps = ["2020-01-31 23:00", "2020-02-01 00:00", "2020-03-30 00:00", "2020-03-30 01:00"]
    data = [("PJM", datetime.fromisoformat(s), float(i), None) for i, s in enumerate(stamps)]
    data.append(("MISO", datetime(2020, 2, 2), 9.0, 9.0))
    df = spark.createDataFrame(data, "ba string, t timestamp_ntz, x double, y double")
    args = ("PJM", "2020-02-01", "2020-03-30", ["x", "y"], "ba", "t")
    assert [r[1] for r in rows(op.series_extract(df, *args))] == [1.0, 2.0]
    long = op.series_extract(df, *args, long=True)
    assert long.count() == 4
    assert long.where(F.col("value").isNull()).count() == 2
