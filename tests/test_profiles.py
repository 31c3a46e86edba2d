from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import profiles as op
from gridloom.plans.export import export_wide
from gridloom.sources.csv import read_csv
from gridloom.sources.storage import new_folder
from helpers import close, rows

START = datetime(2023, 6, 21)

SCHEMA = (
    "county_id_fips string, place_name string, state string, report_year int, hour_of_year int,"
    " datetime_utc timestamp_ntz, capacity_factor_solar_pv double,"
    " capacity_factor_onshore_wind double, capacity_factor_offshore_wind double"
)


def hour(fips, place, state, h, solar, wind, offshore=None):
    return (fips, place, state, 2023, h, START + timedelta(hours=h), solar, wind, offshore)


@pytest.fixture
def profiles(spark):
    data = [
        hour("08075", "Logan", "CO", 0, 0.29, 0.5),
        hour("08075", "Logan", "CO", 1, 0.57, 1.0),
        hour("08075", "Logan", "CO", 2, 1.0, None),
        hour("48001", "St. Clair", "TX", 0, 0.0, 0.1),
        hour("48001", "St. Clair", "TX", 2, 0.2, 0.3),
        hour("48003", "Andrews", "TX", 2, 0.4, 0.6),
        hour(None, "Lake Erie", "TX", 0, 0.7, 0.8, 0.9),
        hour("02001", "Nome", None, 0, 0.7, 0.8),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def counties(spark):
    data = [("08075", b"\x01"), ("48001", b"\x02"), ("02001", b"\x03"), (None, b"\x04")]
    return spark.createDataFrame(data, "county_id_fips string, geometry binary")


def test_exclude_prefixes(counties):
    assert rows(op.exclude_prefixes(counties), "county_id_fips") == [("08075",), ("48001",)]


def test_geo_join_drops_lakes_and_keeps_geometry(counties, profiles):
    joined = op.geo_join(counties, profiles, "TX")
    assert joined.columns[:2] == ["county_id_fips", "geometry"]
    found = rows(joined, "county_id_fips", "geometry", "hour_of_year")
    assert found == [("48001", b"\x02", 0), ("48001", b"\x02", 2)]
    assert op.geo_join(counties, profiles).count() == 6


def test_snapshot(profiles):
    assert op.snapshot(profiles, "2023-06-21 01:00:00").count() == 1


def test_frames_number_the_times_that_are_shown(profiles, counties):
    found = op.frames(
        profiles, counties, "capacity_factor_solar_pv", "2023-06-21", "2023-06-21 02:00:00"
    )
    assert rows(found, "county_id_fips", "frame") == [
        ("02001", 0), ("08075", 0), ("08075", 1), ("08075", 2), ("48001", 0), ("48001", 2)
    ]
    titles = rows(found.where("frame = 1"), "frame_title")
    assert titles == [("Capacity Factor Solar Pv 2023-06-21 01:00:00 UTC",)]


def test_numbered_times_count_on_across_hours(spark):
    moments = [START + timedelta(minutes=17 * i, microseconds=i) for i in range(60)]
    df = spark.createDataFrame([(m,) for m in moments * 2], "t timestamp_ntz")
    assert rows(op.numbered_times(df, "t")) == [(m, i) for i, m in enumerate(moments)]


def test_wide_keeps_lakes_quotes_names_and_drops_missing_places(profiles):
    headers = op.headers_of(profiles)
    table = op.wide(profiles, headers, ["capacity_factor_solar_pv"])
    assert headers == table.columns[3:]
    assert table.columns[3:] == ["Andrews__tx", "Lake Erie__tx", "Logan__co", "St. Clair__tx"]
    assert rows(table, "hour_of_year", "St. Clair__tx", "Lake Erie__tx") == [
        (0, 0.0, 0.7), (1, None, None), (2, 0.2, None)
    ]


def test_wide_fails_on_a_repeated_time_and_place(profiles):
    twice = profiles.union(profiles.where("place_name = 'Logan'"))
    with pytest.raises(Exception, match="time and place repeat"):
        op.wide(twice, op.headers_of(twice), ["capacity_factor_solar_pv"]).collect()


def test_wide_fails_on_a_place_beyond_the_headers(profiles):
    with pytest.raises(Exception, match="not among the headers: Andrews__tx"):
        op.wide(profiles.where("place_name = 'Andrews'"), ["Logan__co"], ["capacity_factor_solar_pv"]).collect()


def test_headers_come_from_the_places_alone(spark, profiles):
    places = profiles.select("place_name", "state").union(
        spark.createDataFrame([(None, "TX"), ("Unmet", "NM")], "place_name string, state string")
    )
    headers = op.headers_of(places)
    assert "Unmet__nm" in headers and len(headers) == len(set(headers))
    table = op.wide(profiles, headers, ["capacity_factor_solar_pv"])
    assert {r[0] for r in rows(table, "Unmet__nm")} == {None}


def test_wide_and_back(profiles):
    kept = profiles.where("place_name IN ('Logan', 'Andrews')")
    table = op.wide(kept, ["Logan__co", "Andrews__tx"], ["capacity_factor_solar_pv"])
    back = table.unpivot(list(op.TIME_COLUMNS), table.columns[3:], "place", "value")
    kept = kept.select(
        F.concat("place_name", F.lit("__"), F.lower("state")), "capacity_factor_solar_pv"
    )
    assert rows(back.dropna(subset=["value"]), "place", "value") == rows(kept)


def test_export_gives_one_table_per_measure(spark, profiles):
    folder = new_folder(spark)
    tables = export_wide(profiles, folder, op.headers_of(profiles))
    assert set(tables) == set(op.MEASURES)
    for measure, table in tables.items():
        assert table.columns[:3] == list(op.TIME_COLUMNS)
        assert "Logan__co" in table.columns
        assert rows(read_csv(spark, f"{folder}/{measure}", table.schema)) == rows(table)
    assert rows(tables["capacity_factor_offshore_wind"], "Lake Erie__tx") == [
        (None,), (None,), (0.9,)
    ]


def test_wide_measure_tells_apart_measures_with_a_common_ending(spark):
    schema = "t int, p string, s string, a double, b_a double"
    df = spark.createDataFrame([(1, "P", "S", 1.0, 2.0)], schema)
    combined = op.wide(df, ["P__s"], ["a", "b_a"], ["t"], "p", "s")
    for measure, value in (("a", 1.0), ("b_a", 2.0)):
        table = op.wide_measure(combined, measure, ["a", "b_a"], ["t"])
        assert table.columns == ["t", "P__s"]
        assert rows(table) == [(1, value)]


VALUES = [0.29, 0.57, 1.0, 0.0, None, -0.1, 1.2, 0.3, 0.30000000000000004, 0.999]


def test_histogram_agrees_with_numpy(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v double")
    found = rows(op.histogram(df, "v"), "bin", "n", "max_value")
    expected, _ = np.histogram([v for v in VALUES if v is not None], bins=100, range=(0, 1))
    assert [r[1] for r in found] == expected.tolist()
    assert {r[2] for r in found} == {1.2}


def test_histogram_by_group_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.9), ("b", None)], "k string, v double")
    found = rows(op.histogram(df, "v", bins=2, by=["k"]), "k", "bin", "n", "max_value")
    assert found == [("a", 0, 1, 0.9), ("a", 1, 1, 0.9), ("b", 0, 0, None), ("b", 1, 0, None)]
    empty = rows(op.histogram(df.where("false"), "v", bins=3), "bin", "n")
    assert empty == [(0, 0), (1, 0), (2, 0)]


def test_histogram_of_single_precision_values(spark):
    df = spark.createDataFrame([(0.29,), (0.57,)], "v float")
    found = {r[0] for r in rows(op.histogram(df, "v"), "bin", "n") if r[1]}
    expected, _ = np.histogram(np.array([0.29, 0.57], "float32").astype(float), 100, (0, 1))
    assert found == set(np.flatnonzero(expected).tolist())


def test_histogram_title(spark):
    df = spark.createDataFrame([("Logan", "CO", 0.987)], "p string, s string, m double")
    title = df.select(op.histogram_title("p", "s", "onshore_wind", "m"))
    assert rows(title) == [("county: Logan; state: CO; gen: onshore_wind; max:0.99",)]


def test_county_histogram_has_the_earliest_name(spark, profiles):
    later = spark.createDataFrame([hour("08075", "Renamed", "CO", 9, 0.1, None)], SCHEMA)
    found = op.county_histograms(profiles.union(later), "solar_pv", "08075")
    assert {r[0] for r in rows(found, "title")} == {
        "county: Logan; state: CO; gen: solar_pv; max:1.00"
    }
    expected, _ = np.histogram([0.1, 0.29, 0.57, 1.0], bins=100, range=(0, 1))
    assert [r[1] for r in rows(found, "bin", "n")] == expected.tolist()
    assert op.county_histograms(profiles, "solar_pv").count() == 400


def test_mean_and_variance_rows(profiles):
    stats = op.mean_var_long(profiles)
    found = rows(
        stats, "place_name", "gen_type", "average_capacity_factor", "average_variance"
    )
    values = np.array([0.29, 0.57, 1.0])
    expected = [
        # One hour only: a mean but no variance. Nothing known: no row at all.
        ("Andrews", "onshore_wind", 0.6, None),
        ("Andrews", "solar_pv", 0.4, None),
        ("Logan", "onshore_wind", 0.75, 0.125),
        ("Logan", "solar_pv", float(values.mean()), float(values.var(ddof=1))),
        ("St. Clair", "onshore_wind", 0.2, 0.02),
        ("St. Clair", "solar_pv", 0.1, 0.02),
    ]
    assert close(found, expected)


@pytest.fixture
def statistics(spark):
    data = [("solar", 0.2, 0.01), ("solar", 0.4, 0.05), ("wind", 0.3, 0.03), ("wind", 0.0, 0.03),
            ("wind", 0.5, None)]
    return spark.createDataFrame(
        data, "gen_type string, average_capacity_factor double, average_variance double"
    )


def test_brushed_average(statistics):
    assert close(rows(op.brushed_average(statistics)), [("solar", 0.3, True), ("wind", 0.4, True)])
    inside = op.brushed_average(statistics, (0.02, 0.05), ["wind"])
    assert rows(inside) == [("solar", 0.4, False), ("wind", 0.3, True)]


def test_scatter_points(statistics):
    points = op.scatter_points(statistics, (0.02, 0.04), ["wind"])
    assert rows(points, "average_capacity_factor", "in_range") == [
        (0.0, True), (0.3, True), (0.5, False)
    ]
    assert op.scatter_points(statistics).where("in_range").count() == 5
