from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from gridloom.operators import explorer as op
from helpers import rows

PLANTS = (
    "plant_id_eia int, plant_name_eia string, report_date date, state string, county string,"
    " city string, latitude double, sector_name_eia string"
)
GENERATORS = (
    "plant_id_eia int, report_date date, generator_id string, technology_description string,"
    " operational_status string, prime_mover_code string, fuel_type_code string,"
    " capacity_mw double, county string"
)
MONTHLY = (
    "plant_id_eia int, report_date date, generator_id string, fuel_type_code string,"
    " net_generation_mwh double"
)
Y23, Y24 = date(2023, 1, 1), date(2024, 1, 1)


@pytest.fixture
def plants(spark):
    data = [
        (3, "Barry", Y23, "AL", "Mobile", "Bucks", 31.0, "IPP"),
        (3, "Barry", Y24, "AL", "Mobile", "Bucks", None, "IPP"),
        (7, "Adams", Y24, "AL", "Baldwin", "", 30.0, None),
        (55241, "Hog Bayou", Y24, "AL", "Mobile", None, 30.0, None),
        (9, "Zuni", Y24, "CO", None, None, 39.0, None),
        (8, "Lost", Y24, None, "Mobile", None, 39.0, None),
    ]
    return spark.createDataFrame(data, PLANTS)


@pytest.fixture
def generators(spark):
    data = [
        (55241, Y24, "CT1", "Gas CC", "existing", "CT", "gas", 1.5, "Mobile"),
        (55241, Y24, "ST1", "Gas CC", "existing", "CA", "gas", 1.0, "Mobile"),
        (3, Y24, "1", "Coal", "existing", "ST", "coal", 100.4, "Mobile"),
        # The same generator twice, but for a column of the plant.
        (3, Y24, "1", "Coal", "existing", "ST", "coal", 100.4, "Mobile County"),
        (3, Y24, "2", "Gas CC", "retired", None, "gas", 50.0, "Mobile"),
        (3, Y24, "3", None, "retired", "CT", None, None, "Mobile"),
        (3, Y24, "4", "Gas CC", None, "CT", None, 7.0, "Mobile"),
        (3, Y23, "1", "Coal", "existing", "ST", "coal", 99.0, "Mobile"),
    ]
    return spark.createDataFrame(data, GENERATORS)


@pytest.fixture
def monthly(spark):
    data = [
        (3, date(2022, 5, 1), "1", "oil", 5.0),
        (3, date(2023, 12, 1), "1", "coal", 10.0),
        (3, date(2024, 1, 1), "1", "gas", 20.0),
        (3, date(2024, 1, 1), "2", "gas", None),
        (3, date(2024, 1, 1), None, None, 1.0),
        (55241, date(2024, 12, 1), "CT1", "gas", None),
        (55241, date(2025, 1, 1), "CT1", "sun", 2.0),
    ]
    return spark.createDataFrame(data, MONTHLY)


def test_facets(plants):
    assert rows(op.state_options(plants)) == [(None, False), ("AL", False), ("CO", True)]
    assert rows(op.county_options(plants)) == [
        ("AL", "Baldwin", True), ("AL", "Mobile", False), ("CO", None, False)
    ]
    assert rows(op.plant_options(plants), "county", "label", "is_default") == [
        ("Baldwin", "Adams (id=7)", True),
        ("Mobile", "Barry (id=3)", True),
        ("Mobile", "Hog Bayou (id=55241)", False),
    ]


def test_years(plants):
    newest = rows(op.year_options(plants).where("plant_id_eia = 3"), "year", "is_default", "label")
    assert newest == [(2023, False, "2023"), (2024, True, "2024")]
    start = op.start_year_options(plants, selected_year=2023)
    assert rows(start, "plant_id_eia", "year", "is_default") == [(3, 2023, True)]


def test_slices(plants, generators, monthly):
    record = op.plant_records(plants.where("plant_id_eia = 3"), 2024)
    assert rows(record, "plant_name_eia", "latitude") == [("Barry", None)]
    months = op.monthly_slice(monthly, 2023, 2024, 3)
    assert rows(months, "report_date", "net_generation_mwh") == [
        (date(2023, 12, 1), 10.0), (Y24, None), (Y24, 1.0), (Y24, 20.0)
    ]
    units = op.generator_slice(generators, record)
    assert "county" not in units.columns
    assert rows(units, "generator_id") == [("1",), ("2",), ("3",), ("4",)]


def test_newest_records(plants):
    found = rows(op.newest_records(plants).where("plant_id_eia = 3"))
    assert found == [(3, Y24)]


def test_summary(plants, generators, monthly):
    found = rows(
        op.plant_summary(generators, monthly, op.newest_records(plants)),
        "plant_id_eia", "fuel_types", "capacity_mw", "generators", "status", "technologies",
    )
    assert found == [
        (3, "coal, gas, oil", 100, 4, "retired (2), existing (1)", "Gas CC (2), Coal (1)"),
        # 2.5 MW rounds to the even 2; the month after the record's year does not count.
        (55241, "gas", 2, 2, "existing (2)", "Gas CC (2)"),
    ]


def test_summary_of_every_record_from_a_start_year(generators, monthly):
    found = rows(
        op.plant_summary(generators, monthly, start_year=2023),
        "plant_id_eia", "report_date", "fuel_types", "generators",
    )
    assert found == [(3, Y23, "coal", 1), (3, Y24, "coal, gas", 4), (55241, Y24, "gas", 2)]


def test_summary_without_known_values(spark, monthly):
    df = spark.createDataFrame([(5, Y24, "1", None, None, None, None, None, None)], GENERATORS)
    found = rows(op.plant_summary(df, monthly))
    assert found == [(5, Y24, "", 0, 1, "", "")]


def test_attribute_card_leaves_out_missing_values(plants):
    records = op.plant_records(plants, 2024).where("plant_id_eia = 3")
    card = op.attribute_card(records, ["plant_id_eia"], ["plant_id_eia", "city", "latitude"])
    assert rows(card) == [(3, "city", "Bucks"), (3, "plant_id_eia", "3")]


def test_net_generation(monthly):
    months = op.monthly_slice(monthly, 2024, 2024)
    assert rows(op.net_generation(months)) == [
        (3, Y24, 21.0), (55241, date(2024, 12, 1), None)
    ]
    by_fuel = op.net_generation(months, ["fuel_type_code"]).where("plant_id_eia = 3")
    assert rows(by_fuel) == [(3, Y24, None, 1.0), (3, Y24, "gas", 20.0)]
    assert op.net_generation_by_generator(months).count() == 4


def test_chart_title(plants):
    titles = rows(plants.where("report_date = '2024-01-01'").select(op.chart_title()))
    assert titles == [
        (None,), (None,),
        ("Net Generation: Adams, Baldwin, AL",),
        ("Net Generation: Barry, Bucks, AL",),
        ("Net Generation: Hog Bayou, Mobile, AL",),
    ]


def test_generator_coverage(plants, generators, monthly):
    found = op.generator_coverage(
        op.monthly_slice(monthly, None, 2024), generators, op.newest_records(plants)
    )
    assert rows(found) == [
        # Two known ids and a missing one.
        (3, 3, 4, "Generation data available for 3 of 4 generators for this plant."),
        (55241, 1, 2, "Generation data available for 1 of 2 generators for this plant."),
    ]
    full = op.generator_coverage(monthly, generators.where("report_date = '2023-01-01'"))
    assert rows(full) == [(3, 3, 1, None)]


def test_facet_options(generators):
    units = op.generator_rows(generators).where("plant_id_eia = 3 AND report_date = '2024-01-01'")
    found = rows(
        op.facet_options(units, ["fuel_type_code", "technology_description"]),
        "facet", "value", "label", "n", "only_option",
    )
    assert found == [
        ("fuel_type_code", None, "None", 2, False),
        ("fuel_type_code", "coal", "coal", 1, False),
        ("fuel_type_code", "gas", "gas", 1, False),
        ("technology_description", None, "None", 1, False),
        ("technology_description", "Coal", "Coal", 1, False),
        ("technology_description", "Gas CC", "Gas CC", 2, False),
    ]


def test_facets_with_one_option_or_none(generators):
    units = generators.where("plant_id_eia = 55241")
    units = units.withColumn("prime_mover_code", F.lit(None).cast("int"))
    found = op.facet_options(units, ["prime_mover_code", "technology_description"])
    assert rows(found, "facet", "value", "only_option") == [
        ("technology_description", "Gas CC", True)
    ]


def test_filter_by_prime_mover_selects_one_of_two(generators):
    units = op.generator_rows(generators.where("plant_id_eia = 55241"))
    choice = {"prime_mover_code": ["CA"], "operational_status": []}
    assert rows(op.filter_generators(units, choice), "generator_id") == [("ST1",)]
    message = rows(op.selection_message(units, choice), "message")
    assert message == [("1 of 2 generators selected",)]
    assert rows(op.selection_message(units, {}), "message") == [("All 2 generators selected",)]


def test_filter_by_a_missing_value(generators):
    units = op.generator_rows(generators).where("plant_id_eia = 3 AND report_date = '2024-01-01'")
    found = op.filter_generators(units, {"fuel_type_code": [None, "coal"]})
    assert rows(found, "generator_id") == [("1",), ("3",), ("4",)]


def test_one_generator_gets_no_message(generators):
    units = generators.where("report_date = '2023-01-01'")
    assert rows(op.selection_message(units, {}), "message") == [(None,)]


def test_attribute_order():
    columns = ["zeta", "capacity_mw", "generator_id", "prime_mover_code", "alpha",
               "technology_description"]
    assert op.attribute_order(columns) == [
        "technology_description", "capacity_mw", "prime_mover_code", "alpha", "zeta"
    ]


def test_transpose(generators):
    units = generators.where("plant_id_eia = 55241").drop("plant_id_eia", "report_date")
    units = units.withColumn("empty", F.lit(None).cast("int"))
    order = op.attribute_order(units.columns)
    cells = op.transpose_attributes(units, order)
    assert cells.columns == ["attribute", "cells"]
    table = op.transpose_attributes(units, order, ids=["CT1", "ST1"])
    assert table.columns == ["attribute", "CT1", "ST1"]
    assert [tuple(r) for r in table.collect()] == [
        (r["attribute"], r["cells"].get("CT1"), r["cells"].get("ST1")) for r in cells.collect()
    ] == [
        ("technology_description", "Gas CC", "Gas CC"),
        ("operational_status", "existing", "existing"),
        ("capacity_mw", "1.5", "1.0"),
        ("fuel_type_code", "gas", "gas"),
        ("prime_mover_code", "CT", "CA"),
        ("county", "Mobile", "Mobile"),
    ]
    with pytest.raises(Exception, match="generator repeats"):
        op.transpose_attributes(units.union(units), order).collect()
    # A generator that is not asked for takes no column, one that is not there an empty one.
    other = op.transpose_attributes(units, order, ids=["ST1", "none"])
    assert [tuple(r)[1:] for r in other.collect()][2] == ("1.0", None)


def test_attributes_long_of_many_plants(generators):
    found = op.attributes_long(generators, ["prime_mover_code"], ["plant_id_eia", "report_date"])
    assert ("prime_mover_code", "CA") in rows(found, "attribute", "value")
    assert found.columns == ["plant_id_eia", "report_date", "generator_id", "attribute", "value"]
