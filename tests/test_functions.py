from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import columns as c
from gridloom.functions import labels
from gridloom.functions.bins import bin_index
from gridloom.functions.guards import only_value, unique_rows
from gridloom.functions.sharing import kept_whole
from helpers import by_key, plan, rows


def test_sum0_counts_a_null_group_as_zero(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", None), ("b", None)], "k string, v double")
    assert by_key(df.groupBy("k").agg(c.sum0("v").alias("s")), "k", "s") == {"a": 1.5, "b": 0.0}


def test_max_strict_is_null_if_either_side_is(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 2.0), (2, None, 2.0), (3, 1.0, None)], "i int, a double, b double"
    )
    found = by_key(df.withColumn("m", c.max_strict("a", "b")), "i", "m")
    assert found == {1: 2.0, 2: None, 3: None}


def test_relative_error_is_zero_for_zero_and_null(spark):
    data = [(1, 12.0, 10.0), (2, 0.0, 10.0), (3, 5.0, 0.0), (4, None, 10.0), (5, 5.0, None)]
    df = spark.createDataFrame(data, "i int, f double, r double")
    found = by_key(df.withColumn("e", c.relative_error("f", "r")), "i", "e")
    assert found == {1: 0.2, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_percent_change_from_zero_is_null(spark):
    df = spark.createDataFrame([(1, 4.0, 5.0), (2, 0.0, 5.0)], "i int, a double, b double")
    assert by_key(df.withColumn("p", c.percent_change("a", "b")), "i", "p") == {1: 25.0, 2: None}


@pytest.mark.parametrize(
    ("options", "expected"),
    [(["x"], {1}), (["x", None], {1, 3}), ([None], {3}), ([], set())],
)
def test_isin_nullsafe(spark, options, expected):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, v string")
    assert {r.i for r in df.where(c.isin_nullsafe("v", options)).collect()} == expected


def test_strip_ws_removes_every_kind_of_white_space(spark):
    texts = ["\t a b \n", " x ", " ", "", "\x1cq\x1f", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = by_key(df.withColumn("s", c.strip_ws("t")), "i", "s")
    assert found == {i: None if t is None else t.strip() for i, t in enumerate(texts)}


def test_has_prefix(spark):
    df = spark.createDataFrame([("02001",), ("08075",), (None,)], "id string")
    assert rows(df.where(~c.has_prefix("id", ["02", "15"]))) == [("08075",)]


def test_year_range_covers_whole_years(spark):
    days = ["1999-12-31", "2000-01-01", "2001-12-31", "2002-01-01"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    assert [str(r[0]) for r in rows(df.where(c.year_range("d", 2000, 2001)))] == days[1:3]
    assert df.where(c.year_range("d", None, None)).count() == 4


def test_lower_strings_leaves_other_columns(spark):
    df = spark.createDataFrame([("Ab C", 1)], "`a.b` string, n int")
    assert rows(c.lower_strings(df)) == [("ab c", 1)]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "i int, v double")
    assert by_key(c.nan_to_null(df), "i", "v") == {1: None, 2: 1.0}


def test_strip_prefix_renames_matching_columns_only(spark):
    df = spark.createDataFrame([(1, 2, 3)], "capacity_factor_x int, y int, my_capacity_factor_ int")
    assert c.strip_prefix(df, "capacity_factor_").columns == ["x", "y", "my_capacity_factor_"]


# Exact ties, near ties, signs and plain values.
NUMBERS = [0.125, 0.375, 2.5, 3.5, 22.075, 0.15, 0.25, 0.35, 1.005, -0.04, -0.05, 0.0, 1234567.885]
NUMBERS += [random.Random(1).uniform(-200, 200) for _ in range(500)]
NUMBERS += [i / 1000 for i in range(1000)]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_agrees_with_exact_rounding(spark, digits):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(NUMBERS)], "i int, v double")
    found = by_key(df.withColumn("t", labels.fixed("v", digits)), "i", "t")
    assert found == {i: f"{v:.{digits}f}" for i, v in enumerate(NUMBERS)}


def test_labels(spark):
    df = spark.createDataFrame(
        [(1, "", "Ada", None), (2, "Rye", "Ada", "n"), (3, None, "Ada", "n")],
        "i int, city string, county string, name string",
    )
    assert by_key(df.withColumn("t", labels.text_or("city", "county")), "i", "t") == {
        1: "Ada", 2: "Rye", 3: "Ada"
    }
    named = by_key(df.withColumn("t", labels.name_with_id("name", "i")), "i", "t")
    assert named == {1: "None (id=1)", 2: "n (id=2)", 3: "n (id=3)"}
    headers = by_key(df.withColumn("t", labels.place_header("name", "county")), "i", "t")
    assert headers == {1: None, 2: "n__ada", 3: "n__ada"}
    assert labels.title_words("capacity_factor_solar_pv") == "Capacity Factor Solar Pv"
    shown = df.limit(1).select(labels.title_case(F.lit("onshore_wind")).alias("t"))
    assert rows(shown) == [("Onshore Wind",)]


def test_bins_agree_with_numpy_on_edges(spark):
    edges = [i / 100 for i in range(101)] + [i * 0.01 for i in range(101)]
    values = edges + [i / 10000 for i in range(10001)] + [-0.001, 1.001, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    counted = df.groupBy(bin_index("v", 100, 0.0, 1.0).alias("b")).count().where("b IS NOT NULL")
    found = by_key(counted, "b", "count")
    expected, _ = np.histogram(values, bins=100, range=(0, 1))
    assert [found.get(i, 0) for i in range(100)] == expected.tolist()


@settings(max_examples=15, deadline=None)
@given(
    st.lists(st.floats(-3, 9, allow_nan=False), min_size=1, max_size=200),
    st.sampled_from([(7, -1.0, 2.5), (10, 0.0, 3.0), (100, 2.0, 2.5)]),
)
def test_bins_agree_with_numpy_on_any_range(spark, values, shape):
    bins, low, high = shape
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    counted = df.groupBy(bin_index("v", bins, low, high).alias("b")).count()
    found = by_key(counted.where("b IS NOT NULL"), "b", "count")
    expected, _ = np.histogram(values, bins=bins, range=(low, high))
    assert [found.get(i, 0) for i in range(bins)] == expected.tolist()


def test_unique_rows_also_sees_null_keys(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b int, `c.d` string")
    assert unique_rows(df, ["a", "b"], "twice").schema == df.schema
    assert rows(unique_rows(df, ["a", "b"], "twice")) == rows(df)
    assert rows(unique_rows(df.select("a"), ["a"], "twice")) == [(1,), (2,)]
    for keys, columns in ((["b"], ["a", "b"]), (["b"], ["b"])):
        with pytest.raises(Exception, match="twice"):
            unique_rows(df.select(*columns), keys, "twice").count()


def test_unique_rows_ride_in_the_shuffle_of_a_join(spark):
    left = spark.range(100).selectExpr("id % 10 AS k", "id AS v")
    right = spark.range(10).selectExpr("id AS k", "id * 2 AS w")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(unique_rows(right, ["k"], "twice"), "k")
        plain = left.join(right, "k")
        assert plan(joined).count("Exchange") == plan(plain).count("Exchange") == 2
        assert rows(joined) == rows(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kept_whole_gives_the_same_rows(spark):
    data = [(1, "a", 2.0), (1, "b", None), (None, "c", 1.0), (2, None, None)]
    df = spark.createDataFrame(data, "k int, `s.t` string, v double")
    for keys, plain in ((["k"], ["k"]), (["k"], []), (["k", "s.t"], [])):
        whole = kept_whole(df, keys, plain)
        assert whole.columns == df.columns and rows(whole) == rows(df)
    assert rows(kept_whole(df.limit(0), ["k"])) == []
    assert "EqualTo" in plan(kept_whole(df, ["k"], ["k"]).where("k = 1")) or "(k" in plan(
        kept_whole(df, ["k"], ["k"]).where("k = 1")
    )


def test_only_value_fails_on_a_second_row(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    grouped = df.groupBy("k").agg(only_value("v", "twice").alias("v"))
    assert rows(grouped) == [("a", 1), ("b", 2)]
    twice = df.union(df).groupBy("k").agg(only_value("v", "twice").alias("v"))
    with pytest.raises(Exception, match="twice"):
        twice.collect()
