from __future__ import annotations

from datetime import date
from math import log10

import pytest

from gridloom.operators import change as op
from gridloom.plans.area import analyse_area
from helpers import close, rows

SCHEMA = (
    "respondent_id_ferc714 int, respondent_name_ferc714 string, report_date date,"
    " demand_annual_mwh double, area_km2 double"
)


def entity(i, name, demand, *areas):
    return [(i, name, date(2010 + k, 1, 1), demand, a) for k, a in enumerate(areas)]


@pytest.fixture
def summary(spark):
    data = [
        *entity(1, "\tAlpha ", 2e7, None, 100.0, 130.0, None),
        *entity(2, "beta", 4e7, 100.0, 110.0),  # exactly ten percent
        *entity(3, "gamma", None, 100.0, 200.0),  # no demand
        *entity(4, "delta", 5e7, None, None),  # no area
        *entity(5, "eps", 5e7, 0.0, 10.0),  # first area zero
        *entity(6, "zeta", 8e7 + 0.9, 100.0, 50.0),
        *entity(7, "eta", 9e6, 100.0, 200.0),  # small, but first in the gradient
        *entity(None, "none", 9e9, 100.0, 200.0),
    ]
    # The name of the first date counts, whatever the order of the rows.
    data.append((1, "Renamed", date(2019, 1, 1), None, None))
    return spark.createDataFrame(data[::-1], SCHEMA)


def test_area_changes(summary):
    found = rows(op.area_changes(summary))
    assert found == [
        (1, "Alpha", 20000000, 100.0, 130.0, 30.0),
        (6, "zeta", 80000000, 100.0, 50.0, -50.0),
        (7, "eta", 9000000, 100.0, 200.0, 100.0),
    ]


def test_series_scales_over_all_entities_before_the_display_limit(summary):
    _, series = analyse_area(summary)
    first = (log10(2e7) - log10(9e6)) / (log10(8e7) - log10(9e6))
    found = rows(series, "name", "report_date", "pct_change", "gradient", "alpha")
    assert close(found, [
        ("alpha", date(2011, 1, 1), 0.0, first, first**2),
        ("alpha", date(2012, 1, 1), 30.0, first, first**2),
        ("zeta", date(2010, 1, 1), 0.0, 1.0, 1.0),
        ("zeta", date(2011, 1, 1), -50.0, 1.0, 1.0),
    ])


def test_one_entity_has_no_gradient(spark):
    df = spark.createDataFrame(entity(1, "a", 2e7, 1.0, 2.0), SCHEMA)
    _, series = analyse_area(df)
    assert {r[0] for r in rows(series, "gradient")} == {None}


def test_zero_demand_leaves_no_gradient(spark):
    data = entity(1, "a", 0.0, 1.0, 2.0) + entity(2, "b", 2e7, 1.0, 2.0)
    _, series = analyse_area(spark.createDataFrame(data, SCHEMA))
    assert {r for r in rows(series, "name", "gradient")} == {("b", None)}


def test_same_date_needs_a_second_order_column(spark):
    data = [(1, "b", 1, 2, 5.0), (1, "a", 1, 1, 4.0), (1, "c", 1, 3, 6.0)]
    df = spark.createDataFrame(data, "id int, n string, d int, k int, x double")
    found = op.area_changes(df, "id", "n", "x", "x", ["d", "k"])
    assert rows(found) == [(1, "a", 5, 4.0, 6.0, 50.0)]


def test_ties_give_one_answer(spark):
    data = [(1, n, 1, x) for n, x in (("b", 5.0), ("a", 4.0), ("c", 9.0))]
    data += [(1, n, 2, x) for n, x in (("b", 7.0), ("a", 6.0))]
    df = spark.createDataFrame(data, "id int, n string, d int, x double")
    found = {
        str(rows(op.area_changes(df.repartition(k), "id", "n", "x", "x", ["d"])))
        for k in (1, 2, 5)
    }
    assert found == {"[(1, 'a', 6, 4.0, 7.0, 75.0)]"}


def test_lookups(spark):
    data = [(1, "dominion"), (1, "dominion"), (2, "old dominion"), (3, None), (4, "DOMINION")]
    df = spark.createDataFrame(data, "id int, name string")
    assert rows(op.lookup_by_name(df, "dominion", "id", "name")) == [
        (1, "dominion"), (2, "old dominion")
    ]
    assert rows(op.lookup_by_name(df, "^dom", "id", "name")) == [(1, "dominion")]
    assert op.lookup_by_id(df, 1, "id").count() == 2
