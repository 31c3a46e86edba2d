"""Drill-down from states to single generators.

Every function works on all plants at once; filter its input to work on one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, isin_nullsafe, named, sum0, year_range
from ..functions.guards import only_value
from ..functions.labels import counted_values, name_with_id, option_text, text_or

PLANT = "plant_id_eia"
PLANT_NAME = "plant_name_eia"
DATE = "report_date"
GENERATOR = "generator_id"

DEFAULT_STATE = "CO"

# Attributes of the two cards of a plant.
GRID_ATTRIBUTES = (
    "plant_name_eia",
    "plant_id_eia",
    "balancing_authority_code_eia",
    "sector_name_eia",
    "utility_name_eia",
    "utility_id_eia",
)
LOCATION_ATTRIBUTES = (
    "street_address",
    "city",
    "state",
    "zip_code",
    "county",
    "timezone",
    "latitude",
    "longitude",
)

# Columns of the yearly generator table that describe the plant. Plant and date
# stay as keys, since these functions work on many plants at once.
PLANT_LEVEL_COLUMNS = (
    "plant_id_eia",
    "report_date",
    "plant_id_pudl",
    "plant_name_eia",
    "utility_id_eia",
    "utility_id_pudl",
    "utility_name_eia",
    "balancing_authority_code_eia",
    "balancing_authority_name_eia",
    "state",
    "street_address",
    "timezone",
    "zip_code",
    "latitude",
    "longitude",
    "city",
    "county",
    "data_maturity",
)

# Generator attributes in display order, and those offered as filters.
OPERATION_COLUMNS = (
    "generator_id",
    "technology_description",
    "operational_status",
    "generator_operating_date",
    "original_planned_generator_operating_date",
    "generator_retirement_date",
    "planned_generator_retirement_date",
    "current_planned_generator_operating_date",
    "capacity_factor",
    "capacity_mw",
    "summer_capacity_estimate",
    "summer_capacity_mw",
    "summer_estimated_capability_mw",
    "winter_capacity_estimate",
    "winter_capacity_mw",
    "winter_estimated_capability_mw",
)


def energy_columns(fuel_type: str = "fuel_type_code") -> list[str]:
    sources = [f"energy_source_code_{i}" for i in range(1, 7)]
    return ["generator_id", fuel_type, "prime_mover_code", *sources]


def facet_columns(unit: str = "unit_id", fuel_type: str = "fuel_type_code") -> list[str]:
    return [
        "generator_id",
        unit,
        "technology_description",
        "energy_source_code_1",
        "prime_mover_code",
        "operational_status",
        fuel_type,
        "associated_combined_heat_power",
        "operational_status_code",
    ]


# Facets --------------------------------------------------------------------------------


def _options(df: DataFrame, within: Sequence[str], option: Mapping[str, Column]) -> DataFrame:
    columns = [named(c) for c in within] + [v.alias(k) for k, v in option.items()]
    return df.select(*columns).dropna(subset=list(within) or None, how="any").distinct()


def _flag_default(
    options: DataFrame, within: Sequence[str], order: Column, newest: bool = False
) -> DataFrame:
    """Marks the first option of each group in the given order (the last, if ``newest``)."""
    group = Window.partitionBy(*[named(c) for c in within])
    best = (F.max if newest else F.min)(order).over(group)
    return options.withColumn("is_default", F.coalesce(order == best, F.lit(False)))


def state_options(
    plants: DataFrame, state: str = "state", default: str = DEFAULT_STATE
) -> DataFrame:
    states = plants.select(named(state)).distinct()
    return states.select(
        named(state), F.coalesce(named(state) == default, F.lit(False)).alias("is_default")
    )


def county_options(plants: DataFrame, state: str = "state", county: str = "county") -> DataFrame:
    """Counties of each state; the first by name is the default."""
    options = _options(plants, [state], {county: named(county)})
    return _flag_default(options, [state], named(county))


def plant_options(
    plants: DataFrame,
    state: str = "state",
    county: str = "county",
    plant: str = PLANT,
    name: str = PLANT_NAME,
) -> DataFrame:
    """Plants of each county with their label; the lowest id is the default."""
    options = _options(plants, [state, county], {plant: named(plant), name: named(name)})
    flagged = _flag_default(options, [state, county], F.struct(named(plant), named(name)))
    return flagged.withColumn("label", name_with_id(name, plant))


def year_options(plants: DataFrame, plant: str = PLANT, date: str = DATE) -> DataFrame:
    """Years on record for each plant; the newest is the default."""
    options = _options(plants, [plant], {"year": F.year(named(date))})
    flagged = _flag_default(options, [plant], F.col("year"), newest=True)
    return flagged.withColumn("label", option_text("year"))


def start_year_options(
    plants: DataFrame,
    selected_year: int | None = None,
    plant: str = PLANT,
    date: str = DATE,
) -> DataFrame:
    """Start years up to the selected year; the earliest on record is the default."""
    options = _options(plants, [plant], {"year": F.year(named(date))})
    flagged = _flag_default(options, [plant], F.col("year"))
    if selected_year is not None:
        flagged = flagged.where(F.col("year") <= selected_year)
    return flagged.withColumn("label", option_text("year"))


# Slices --------------------------------------------------------------------------------

# Shares in which rows are dealt out, many more than the tasks of a shuffle.
PLACES = 1 << 15


def plant_records(
    plants: DataFrame,
    year: int | None = None,
    plant: str = PLANT,
    date: str = DATE,
) -> DataFrame:
    """One record per plant and year: the earliest of the year."""
    rows = plants.where(year_range(date, year, year)).where(named(plant).isNotNull())
    others = [c for c in plants.columns if c != plant]
    record = F.struct(*[named(c) for c in others])
    first = F.min_by(record, F.struct(named(date), *[named(c) for c in others if c != date]))
    return (
        rows.groupBy(named(plant), F.year(named(date)).alias("__year"))
        .agg(first.alias("__record"))
        .select(named(plant), *[named("__record")[c].alias(c) for c in others])
    )


def newest_records(plants: DataFrame, plant: str = PLANT, date: str = DATE) -> DataFrame:
    """Plant and date of its newest record."""
    return (
        plants.where(named(plant).isNotNull())
        .groupBy(named(plant))
        .agg(F.max(named(date)).alias(date))
    )


def monthly_slice(
    monthly: DataFrame,
    first_year: int | None = None,
    last_year: int | None = None,
    plant_id: int | None = None,
    columns: Sequence[str] | None = None,
    plant: str = PLANT,
    date: str = DATE,
) -> DataFrame:
    """Monthly rows in a range of years, of one plant if given."""
    rows = monthly if columns is None else monthly.select(*[named(c) for c in columns])
    if plant_id is not None:
        rows = rows.where(named(plant) == plant_id)
    return rows.where(year_range(date, first_year, last_year))


def months_of_records(
    monthly: DataFrame, records: DataFrame, plant: str = PLANT, date: str = DATE
) -> DataFrame:
    """Monthly rows of the year of their plant's record; each plant has one record."""
    years = records.select(named(plant), F.year(named(date)).alias("__year")).distinct()
    rows = monthly.withColumn("__year", F.year(named(date)))
    return rows.join(years, [plant, "__year"], "left_semi").select(monthly.columns)


def _generator_columns(
    generators: DataFrame, drop: Sequence[str], plant: str, date: str
) -> DataFrame:
    kept = [c for c in generators.columns if c not in set(drop) - {plant, date}]
    return generators.select(*[named(c) for c in kept])


def generator_rows(
    generators: DataFrame,
    drop: Sequence[str] = PLANT_LEVEL_COLUMNS,
    plant: str = PLANT,
    date: str = DATE,
) -> DataFrame:
    """Distinct generator rows without the columns that describe the plant.

    The rows a task compares are held in its memory, so they are first dealt out by their size,
    equal ones to one place; the split of a scan may hold very many. The place is no column of
    theirs, so that Spark may share out a place with many repeats among several tasks.
    """
    rows = _generator_columns(generators, drop, plant, date)
    place = F.pmod(F.hash(*map(named, rows.columns)), F.lit(PLACES)).cast("short")
    dealt = rows.withColumn("__place", place).hint("rebalance", "__place")
    return dealt.drop("__place").distinct()


def at_records(
    df: DataFrame, records: DataFrame | None, plant: str = PLANT, date: str = DATE
) -> DataFrame:
    """Rows whose plant and exact date match a plant record; all rows without records."""
    if records is None:
        return df
    chosen = records.select(named(plant), named(date)).distinct()
    return df.join(chosen, [plant, date], "left_semi")


def generator_slice(
    generators: DataFrame,
    records: DataFrame | None,
    drop: Sequence[str] = PLANT_LEVEL_COLUMNS,
    plant: str = PLANT,
    date: str = DATE,
) -> DataFrame:
    """Distinct generator rows of the given plant records.

    Rows meet the records first, so that only the wanted ones are compared, where they met.
    """
    if records is None:
        return generator_rows(generators, drop, plant, date)
    met = at_records(generators, records, plant, date)
    return _generator_columns(met, drop, plant, date).distinct()


# Summary and cards ---------------------------------------------------------------------


def plant_summary(
    generators: DataFrame,
    fuels: DataFrame,
    records: DataFrame | None = None,
    start_year: int | None = None,
    drop: Sequence[str] = PLANT_LEVEL_COLUMNS,
    plant: str = PLANT,
    date: str = DATE,
    fuel_type: str = "fuel_type_code",
    status: str = "operational_status",
    technology: str = "technology_description",
    capacity: str = "capacity_mw",
) -> DataFrame:
    """Fuels, existing capacity, generator count, statuses and technologies of each record.

    ``generators`` is the yearly table or a slice of it, ``fuels`` the monthly table by
    fuel, ``records`` the plants and dates wanted. Fuels are those of the months from the
    start year, or the first on record, to the record's year.
    """
    key = [plant, date]
    existing = F.when(named(status) == "existing", named(capacity))
    sides = F.array(
        F.struct(
            F.lit("status").alias("side"),
            named(status).alias("value"),
            existing.alias("mw"),
        ),
        F.struct(
            F.lit("technology").alias("side"),
            named(technology).alias("value"),
            F.lit(None).cast("double").alias("mw"),
        ),
    )
    # Counted per value first, so that a plant arrives as a few rows however many
    # generators it has.
    counts = (
        generator_slice(generators, records, drop, plant, date)
        .select(*[named(k) for k in key], F.inline(sides))
        .groupBy(*key, "side", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("mw").alias("mw"))
    )
    is_status = F.col("side") == "status"
    known = F.col("value").isNotNull()
    entry = F.struct("value", "n")
    summary = counts.groupBy(*key).agg(
        F.bround(sum0("mw")).cast("long").alias("capacity_mw"),
        F.sum(F.when(is_status, F.col("n"))).alias("generators"),
        counted_values(F.collect_list(F.when(is_status & known, entry))).alias("status"),
        counted_values(F.collect_list(F.when(~is_status & known, entry))).alias("technologies"),
    )

    first_use = (
        fuels.where(year_range(date, start_year, None))
        .where(named(fuel_type).isNotNull())
        .groupBy(named(plant), named(fuel_type).alias("fuel"))
        .agg(F.min(F.year(named(date))).alias("since"))
    )
    by_plant = first_use.groupBy(plant).agg(
        F.sort_array(F.collect_list(F.struct("fuel", "since"))).alias("__fuels")
    )
    used = F.filter(
        F.coalesce("__fuels", F.array()), lambda f: f["since"] <= F.year(named(date))
    )
    return summary.join(by_plant, plant, "left").select(
        *key,
        F.array_join(F.transform(used, lambda f: f["fuel"]), ", ").alias("fuel_types"),
        "capacity_mw",
        "generators",
        "status",
        "technologies",
    )


def attribute_card(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Chosen attributes of each record as (attribute, value), missing ones left out."""
    prefix = "__key_"
    texts = df.select(
        *[named(k).alias(prefix + k) for k in keys],
        *[named(a).cast("string").alias(a) for a in attributes],
    )
    rows = texts.unpivot([prefix + k for k in keys], list(attributes), "attribute", "value")
    return rows.where("value IS NOT NULL").withColumnsRenamed({prefix + k: k for k in keys})


# Generation series ---------------------------------------------------------------------


def net_generation(
    monthly: DataFrame,
    by: Sequence[str] = (),
    value: str = "net_generation_mwh",
    plant: str = PLANT,
    date: str = DATE,
) -> DataFrame:
    """Net generation per plant and month, and per fuel if asked for."""
    keys = [named(c) for c in (plant, date, *by)]
    return monthly.groupBy(*keys).agg(F.sum(named(value)).alias(value))


def net_generation_by_generator(
    monthly: DataFrame,
    value: str = "net_generation_mwh",
    plant: str = PLANT,
    date: str = DATE,
    generator: str = GENERATOR,
) -> DataFrame:
    return monthly.select(named(plant), named(date), named(generator), named(value))


# The words of the titles and messages below.
def chart_title(
    name: Column | str = PLANT_NAME,
    city: Column | str = "city",
    county: Column | str = "county",
    state: Column | str = "state",
) -> Column:
    name, state = [named(c) if isinstance(c, str) else c for c in (name, state)]
    return F.concat(
        F.lit("Net Generation: "), name, F.lit(", "), text_or(city, county), F.lit(", "), state
    )


def generator_coverage(
    monthly: DataFrame,
    generators: DataFrame,
    records: DataFrame | None = None,
    drop: Sequence[str] = PLANT_LEVEL_COLUMNS,
    plant: str = PLANT,
    date: str = DATE,
    generator: str = GENERATOR,
) -> DataFrame:
    """Generators with monthly data beside generators on record, for plants with such data.

    ``generators`` is the yearly table or a slice of it, ``records`` the one record wanted
    of each plant. A missing generator id counts as one more generator. The message is null
    unless some generator lacks data.
    """
    seen = monthly.groupBy(named(plant)).agg(
        (
            F.count_distinct(named(generator))
            + F.max(named(generator).isNull().cast("int")).cast("long")
        ).alias("n_with_data")
    )
    recorded = (
        generator_slice(generators, records, drop, plant, date)
        .groupBy(named(plant), named(date))
        .agg(F.count(F.lit(1)).alias("n_on_record"))
        .drop(date)
    )
    text = F.concat(
        F.lit("Generation data available for "), F.col("n_with_data").cast("string"),
        F.lit(" of "), F.col("n_on_record").cast("string"),
        F.lit(" generators for this plant."),
    )
    short = F.col("n_with_data") < F.col("n_on_record")
    return seen.join(recorded, plant).withColumn("message", F.when(short, text))


# Generator filters ---------------------------------------------------------------------


def facet_options(
    generators: DataFrame, facets: Sequence[str], keys: Sequence[str] = (PLANT, DATE)
) -> DataFrame:
    """Options of each facet with their row counts; a missing value is an option too.

    A facet without any known value is left out. ``only_option`` marks a facet with one
    option, which is then chosen from the start. Rows are counted per option first, those of a
    key in one task or a few, which then hold few counts; a facet's options then meet in a window.
    """
    keys = list(keys)
    known = generators.dropna(subset=keys).hint("rebalance", *map(named, keys))
    texts = known.select(
        *[named(k).alias(f"__key_{k}") for k in keys],
        *[named(f).cast("string").alias(f) for f in facets],
    ).unpivot([f"__key_{k}" for k in keys], list(facets), "facet", "value")
    counts = (
        texts.withColumnsRenamed({f"__key_{k}": k for k in keys})
        .groupBy(*keys, "facet", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    facet = Window.partitionBy(*[named(k) for k in keys], "facet")
    sized = counts.withColumns(
        {
            "__options": F.count(F.lit(1)).over(facet),
            "__known": F.count("value").over(facet),
        }
    )
    return sized.where("__known > 0").select(
        *keys,
        "facet",
        "value",
        option_text("value").alias("label"),
        "n",
        (F.col("__options") == 1).alias("only_option"),
    )


def selection_test(selections: Mapping[str, Sequence[Any]]) -> Column:
    """Rows that match one chosen option in every facet with a choice."""
    return all_of(isin_nullsafe(c, options) for c, options in selections.items() if options)


def filter_generators(
    generators: DataFrame, selections: Mapping[str, Sequence[Any]]
) -> DataFrame:
    return generators.where(selection_test(selections))


def selection_message(
    generators: DataFrame,
    selections: Mapping[str, Sequence[Any]],
    keys: Sequence[str] = (PLANT, DATE),
) -> DataFrame:
    """Chosen and total generators, with the text shown where there is more than one."""
    chosen = F.coalesce(selection_test(selections), F.lit(False))
    counts = generators.groupBy(*[named(k) for k in keys]).agg(
        F.count(F.when(chosen, F.lit(1))).alias("n_selected"),
        F.count(F.lit(1)).alias("n_generators"),
    )
    share = F.when(F.col("n_selected") == F.col("n_generators"), F.lit("All")).otherwise(
        F.concat(F.col("n_selected").cast("string"), F.lit(" of"))
    )
    text = F.concat(
        share, F.lit(" "), F.col("n_generators").cast("string"), F.lit(" generators selected")
    )
    return counts.withColumn("message", F.when(F.col("n_generators") > 1, text))


# Attribute table -----------------------------------------------------------------------


def attribute_order(
    columns: Sequence[str],
    operation: Sequence[str] = OPERATION_COLUMNS,
    energy: Sequence[str] | None = None,
    generator: str = GENERATOR,
    keys: Sequence[str] = (PLANT, DATE),
) -> list[str]:
    """Operation columns, energy columns, then the remaining ones by name.

    The generator and the key columns are no attributes.
    """
    energy = energy_columns() if energy is None else energy
    first = [c for c in chain(operation, energy) if c in columns]
    rest = sorted(set(columns) - set(operation) - set(energy))
    return [c for c in dict.fromkeys([*first, *rest]) if c not in {generator, *keys}]


def attributes_long(
    generators: DataFrame,
    attributes: Sequence[str],
    keys: Sequence[str] = (),
    generator: str = GENERATOR,
) -> DataFrame:
    """(attribute, generator, value) rows of all records, missing values left out."""
    return attribute_card(generators, [*keys, generator], attributes)


def transpose_attributes(
    generators: DataFrame,
    attributes: Sequence[str],
    generator: str = GENERATOR,
    ids: Sequence[str] | None = None,
) -> DataFrame:
    """One row per attribute with the values of all generators; empty attributes are left out.

    The values of a selection of generators, such as those of one plant, come as one map
    ``cells`` from generator to value; with ``ids`` they come as one column for each of these
    generators, and attributes that none of them has are left out. Rows come in the given order
    of attributes. A generator that occurs twice fails the query.
    """
    place = F.lit(list(attributes))
    cells = attributes_long(generators, attributes, generator=generator)
    cells = cells.withColumn(generator, named(generator).cast("string"))
    if ids is not None:
        cells = cells.where(named(generator).isin(list(ids)))
    # Equal pairs first meet as one row, whose count tells a repeated generator.
    single = cells.groupBy("attribute", named(generator)).agg(
        only_value("value", "a generator repeats").alias("value")
    )
    pairs = F.collect_list(F.struct(named(generator), "value"))
    table = single.groupBy("attribute").agg(F.map_from_entries(pairs).alias("cells"))
    table = table.orderBy(F.array_position(place, F.col("attribute")))
    if ids is None:
        return table
    return table.select("attribute", *[F.try_element_at("cells", F.lit(i)).alias(i) for i in ids])
