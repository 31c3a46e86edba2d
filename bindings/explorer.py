"""Drill-down: suppliers as plants, parts as generators, shipments as months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import explorer as op

from .common import EXPLORER_SQL, generators, monthly, places, plants, register, tidy

KEYS = ["plant_id_eia", "report_date"]


@register(
    "facet_states",
    f"WITH {EXPLORER_SQL} SELECT DISTINCT state, state = 'ASIA' AS is_default FROM plants",
)
def facet_states(spark: SparkSession, folder: str) -> DataFrame:
    return op.state_options(plants(spark, folder), default="ASIA")


@register(
    "facet_counties",
    f"""WITH {EXPLORER_SQL} SELECT DISTINCT state, county,
      county = min(county) OVER (PARTITION BY state) AS is_default FROM plants""",
)
def facet_counties(spark: SparkSession, folder: str) -> DataFrame:
    return op.county_options(plants(spark, folder))


@register(
    "facet_plants",
    f"""WITH {EXPLORER_SQL} SELECT DISTINCT state, county, plant_id_eia, plant_name_eia,
      plant_id_eia = min(plant_id_eia) OVER (PARTITION BY state, county) AS is_default,
      plant_name_eia || ' (id=' || plant_id_eia || ')' AS label FROM plants""",
)
def facet_plants(spark: SparkSession, folder: str) -> DataFrame:
    return op.plant_options(plants(spark, folder))


@register(
    "facet_years",
    f"""WITH {EXPLORER_SQL},
    y AS (SELECT plant_id_eia, CAST(year(report_date) AS INTEGER) AS year FROM plants)
    SELECT DISTINCT plant_id_eia, year,
      year = max(year) OVER (PARTITION BY plant_id_eia) AS is_default,
      CAST(year AS VARCHAR) AS label FROM y""",
)
def facet_years(spark: SparkSession, folder: str) -> DataFrame:
    return op.year_options(plants(spark, folder))


@register(
    "facet_start_years",
    f"""WITH {EXPLORER_SQL},
    y AS (SELECT plant_id_eia, CAST(year(report_date) AS INTEGER) AS year FROM plants),
    d AS (SELECT DISTINCT plant_id_eia, year,
      year = min(year) OVER (PARTITION BY plant_id_eia) AS is_default,
      CAST(year AS VARCHAR) AS label FROM y)
    SELECT * FROM d WHERE year <= 1999""",
)
def facet_start_years(spark: SparkSession, folder: str) -> DataFrame:
    return op.start_year_options(plants(spark, folder), selected_year=1999)


@register(
    "plant_records",
    f"WITH {EXPLORER_SQL} SELECT * FROM plants",
)
def plant_records(spark: SparkSession, folder: str) -> DataFrame:
    return op.plant_records(plants(spark, folder))


@register(
    "monthly_slice",
    f"""WITH {EXPLORER_SQL} SELECT plant_id_eia, report_date, fuel_type_code, net_generation_mwh
    FROM monthly WHERE year(report_date) BETWEEN 1997 AND 1999""",
)
def monthly_slice(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["plant_id_eia", "report_date", "fuel_type_code", "net_generation_mwh"]
    return op.monthly_slice(monthly(spark, folder), 1997, 1999, columns=columns)


ONE_PLANT = 7


@register(
    "monthly_slice_one",
    f"""WITH {EXPLORER_SQL} SELECT plant_id_eia, report_date, fuel_type_code, net_generation_mwh
    FROM monthly WHERE year(report_date) BETWEEN 1997 AND 1999 AND plant_id_eia = {ONE_PLANT}""",
)
def monthly_slice_one(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["plant_id_eia", "report_date", "fuel_type_code", "net_generation_mwh"]
    months = monthly(spark, folder)
    return op.monthly_slice(months, 1997, 1999, plant_id=ONE_PLANT, columns=columns)


NEWEST_SQL = f"""{EXPLORER_SQL},
newest AS (
  SELECT generators.* FROM generators
  JOIN (SELECT plant_id_eia, max(report_date) AS report_date FROM plants GROUP BY 1)
    USING (plant_id_eia, report_date))"""


def _newest(spark: SparkSession, folder: str) -> DataFrame:
    records = op.newest_records(plants(spark, folder))
    return op.generator_slice(generators(spark, folder), records)


@register("generator_slice", f"WITH {NEWEST_SQL} SELECT * FROM newest")
def generator_slice(spark: SparkSession, folder: str) -> DataFrame:
    return _newest(spark, folder)


@register(
    "plant_summary",
    f"""WITH {EXPLORER_SQL},
    main AS (
      SELECT plant_id_eia, report_date,
        CAST(round_even(coalesce(sum(CASE WHEN operational_status = 'existing'
          THEN capacity_mw END), 0), 0) AS BIGINT) AS capacity_mw, count(*) AS generators
      FROM generators GROUP BY ALL),
    sides AS (
      SELECT plant_id_eia, report_date, operational_status AS v, 's' AS side FROM generators
      UNION ALL
      SELECT plant_id_eia, report_date, technology_description, 't' FROM generators),
    counts AS (SELECT *, count(*) AS n FROM sides WHERE v IS NOT NULL GROUP BY ALL),
    texts AS (
      SELECT plant_id_eia, report_date,
        coalesce(string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v)
          FILTER (side = 's'), '') AS status,
        coalesce(string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v)
          FILTER (side = 't'), '') AS technologies
      FROM counts GROUP BY ALL),
    fuels AS (
      SELECT m.plant_id_eia, m.report_date,
        string_agg(DISTINCT fuel_type_code, ', ' ORDER BY fuel_type_code) AS fuel_types
      FROM main m JOIN monthly f ON m.plant_id_eia = f.plant_id_eia
        AND year(f.report_date) <= year(m.report_date) AND year(f.report_date) >= 1996
      WHERE fuel_type_code IS NOT NULL GROUP BY ALL)
    SELECT plant_id_eia, report_date, coalesce(fuel_types, '') AS fuel_types, capacity_mw,
      generators, coalesce(status, '') AS status, coalesce(technologies, '') AS technologies
    FROM main LEFT JOIN texts USING (plant_id_eia, report_date)
    LEFT JOIN fuels USING (plant_id_eia, report_date)""",
)
def plant_summary(spark: SparkSession, folder: str) -> DataFrame:
    units, records = generators(spark, folder), plants(spark, folder)
    return op.plant_summary(units, monthly(spark, folder), records, start_year=1996)


@register(
    "attribute_card",
    f"""WITH {EXPLORER_SQL}
    SELECT plant_id_eia, report_date, attribute, value FROM (
      SELECT plant_id_eia, report_date, 'plant_name_eia' AS attribute, plant_name_eia AS value
      FROM plants
      UNION ALL SELECT plant_id_eia, report_date, 'plant_id_eia', CAST(plant_id_eia AS VARCHAR)
      FROM plants
      UNION ALL SELECT plant_id_eia, report_date, 'city', city FROM plants
      UNION ALL SELECT plant_id_eia, report_date, 'state', state FROM plants
      UNION ALL SELECT plant_id_eia, report_date, 'county', county FROM plants
      UNION ALL SELECT plant_id_eia, report_date, 'latitude', CAST(latitude AS VARCHAR)
      FROM plants)
    WHERE value IS NOT NULL""",
)
def attribute_card(spark: SparkSession, folder: str) -> DataFrame:
    records = op.plant_records(plants(spark, folder))
    wanted = [*op.GRID_ATTRIBUTES, *op.LOCATION_ATTRIBUTES]
    present = [c for c in wanted if c in records.columns]
    return op.attribute_card(records, KEYS, present)


@register(
    "netgen_total",
    f"""WITH {EXPLORER_SQL}, titles AS (
      SELECT plant_id_eia, 'Net Generation: ' || plant_name_eia || ', '
        || coalesce(nullif(city, ''), county) || ', ' || state AS title FROM places)
    SELECT plant_id_eia, report_date, round(sum(net_generation_mwh), 4) AS net_generation_mwh,
      title FROM monthly JOIN titles USING (plant_id_eia) GROUP BY ALL""",
)
def netgen_total(spark: SparkSession, folder: str) -> DataFrame:
    titles = places(spark, folder).select("plant_id_eia", op.chart_title().alias("title"))
    series = op.net_generation(monthly(spark, folder))
    return tidy(series.join(titles, "plant_id_eia"), 4)


@register(
    "netgen_by_fuel",
    f"""WITH {EXPLORER_SQL} SELECT plant_id_eia, report_date, fuel_type_code,
      round(sum(net_generation_mwh), 4) AS net_generation_mwh FROM monthly GROUP BY ALL""",
)
def netgen_by_fuel(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(op.net_generation(monthly(spark, folder), ["fuel_type_code"]), 4)


@register(
    "netgen_by_generator",
    f"""WITH {EXPLORER_SQL}
    SELECT plant_id_eia, report_date, generator_id, net_generation_mwh FROM monthly""",
)
def netgen_by_generator(spark: SparkSession, folder: str) -> DataFrame:
    return op.net_generation_by_generator(monthly(spark, folder))


@register(
    "generator_coverage",
    f"""WITH {NEWEST_SQL},
    seen AS (
      SELECT plant_id_eia,
        count(DISTINCT CASE WHEN fuel_type_code IS NOT NULL THEN generator_id END)
          + max(CASE WHEN fuel_type_code IS NULL THEN 1 ELSE 0 END) AS n_with_data
      FROM monthly JOIN (SELECT plant_id_eia, max(report_date) AS d FROM plants GROUP BY 1)
        USING (plant_id_eia)
      WHERE year(report_date) = year(d) GROUP BY 1),
    units AS (SELECT plant_id_eia, count(*) AS n_on_record FROM newest GROUP BY 1)
    SELECT plant_id_eia, n_with_data, n_on_record, CASE WHEN n_with_data < n_on_record THEN
      'Generation data available for ' || n_with_data || ' of ' || n_on_record
        || ' generators for this plant.' END AS message
    FROM seen JOIN units USING (plant_id_eia)""",
)
def generator_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Months without a fuel lose their generator id, so that some generators lack data."""
    unit = F.when(F.col("fuel_type_code").isNotNull(), F.col("generator_id"))
    records = op.newest_records(plants(spark, folder))
    months = op.months_of_records(monthly(spark, folder), records)
    return op.generator_coverage(
        months.withColumn("generator_id", unit), generators(spark, folder), records
    )


FACETS = ["technology_description", "prime_mover_code", "operational_status", "fuel_type_code"]


@register(
    "facet_options",
    f"""WITH {EXPLORER_SQL},
    long AS ({" UNION ALL ".join(
        f"SELECT plant_id_eia, report_date, '{c}' AS facet, {c} AS value FROM generators"
        for c in FACETS)}),
    counts AS (SELECT *, count(*) AS n FROM long GROUP BY ALL),
    sized AS (SELECT *, count(*) OVER w AS options, count(value) OVER w AS known FROM counts
      WINDOW w AS (PARTITION BY plant_id_eia, report_date, facet))
    SELECT plant_id_eia, report_date, facet, value, coalesce(value, 'None') AS label, n,
      options = 1 AS only_option FROM sized WHERE known > 0""",
)
def facet_options(spark: SparkSession, folder: str) -> DataFrame:
    return op.facet_options(op.generator_rows(generators(spark, folder)), FACETS)


SELECTIONS = {
    "operational_status": ["existing", None],
    "prime_mover_code": ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"],
    "technology_description": [],
}
SELECTED_SQL = """coalesce((operational_status = 'existing' OR operational_status IS NULL)
  AND prime_mover_code IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5'), false)"""


@register("facet_filter", f"WITH {NEWEST_SQL} SELECT * FROM newest WHERE {SELECTED_SQL}")
def facet_filter(spark: SparkSession, folder: str) -> DataFrame:
    return op.filter_generators(_newest(spark, folder), SELECTIONS)


@register(
    "facet_filter_message",
    f"""WITH {EXPLORER_SQL},
    c AS (SELECT plant_id_eia, report_date, count(CASE WHEN {SELECTED_SQL} THEN 1 END)
      AS n_selected, count(*) AS n_generators FROM generators GROUP BY ALL)
    SELECT *, CASE WHEN n_generators > 1 THEN
      CASE WHEN n_selected = n_generators THEN 'All' ELSE n_selected || ' of' END
      || ' ' || n_generators || ' generators selected' END AS message FROM c""",
)
def facet_filter_message(spark: SparkSession, folder: str) -> DataFrame:
    return op.selection_message(op.generator_rows(generators(spark, folder)), SELECTIONS)


@register(
    "attributes_long",
    f"""WITH {NEWEST_SQL}
    SELECT plant_id_eia, generator_id, attribute, value FROM ({" UNION ALL ".join(
        f"SELECT plant_id_eia, generator_id, '{c}' AS attribute, {c} AS value FROM newest"
        for c in FACETS)}) WHERE value IS NOT NULL""",
)
def attributes_long(spark: SparkSession, folder: str) -> DataFrame:
    return op.attributes_long(_newest(spark, folder), FACETS, ["plant_id_eia"])


SHOWN = ["technology_description", "operational_status", "capacity_mw", "fuel_type_code",
         "prime_mover_code"]


def _transpose_sql() -> str:
    """One plant's newest generators: (attribute, value) rows of each, gathered by attribute."""
    rows = " UNION ALL ".join(
        f"SELECT generator_id, '{c}' AS attribute, CAST({c} AS VARCHAR) AS value FROM newest"
        f" WHERE plant_id_eia = {ONE_PLANT}"
        for c in SHOWN
    )
    return f"""WITH {NEWEST_SQL}, cells AS ({rows})
    SELECT attribute, count(value) AS shown,
      string_agg(generator_id || '=' || value, ', ' ORDER BY generator_id) AS generators
    FROM cells WHERE value IS NOT NULL GROUP BY attribute"""


@register("transpose_attributes", _transpose_sql())
def transpose_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per attribute, the generators in order of their ids."""
    of_plant = _newest(spark, folder).where(F.col("plant_id_eia") == ONE_PLANT)
    table = op.transpose_attributes(of_plant, op.attribute_order(of_plant.columns))
    pairs = F.transform(
        F.array_sort(F.map_entries("cells")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return table.select(
        "attribute",
        F.size("cells").cast("long").alias("shown"),
        F.array_join(pairs, ", ").alias("generators"),
    )
