"""Hourly profiles by place: joins to place attributes, reshaping, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_index
from ..functions.columns import all_of, has_prefix, named, strip_prefix
from ..functions.guards import only_value
from ..functions.labels import fixed, place_header, title_words

FIPS = "county_id_fips"
TIME = "datetime_utc"

# FIPS prefixes of states and territories outside the contiguous area.
NONCONTIGUOUS_PREFIXES = ("02", "15", "60", "66", "69", "72", "78")

# Time columns and measures of the wide tables, in output order.
TIME_COLUMNS = ("report_year", "hour_of_year", "datetime_utc")
MEASURES = (
    "capacity_factor_solar_pv",
    "capacity_factor_onshore_wind",
    "capacity_factor_offshore_wind",
)
MEASURE_PREFIX = "capacity_factor_"
GENERATION_TYPES = ("solar_pv", "onshore_wind", "offshore_wind")
STATISTIC_KEYS = ("report_year", "state", "place_name", "county_id_fips")


def exclude_prefixes(
    places: DataFrame,
    prefixes: Sequence[str] = NONCONTIGUOUS_PREFIXES,
    id_col: str = FIPS,
) -> DataFrame:
    """Places whose id starts with none of the prefixes; a null id is left out."""
    return places.where(~has_prefix(id_col, prefixes))


def geo_join(
    places: DataFrame,
    profiles: DataFrame,
    state: str | None = None,
    key: str = FIPS,
    state_col: str = "state",
) -> DataFrame:
    """Hourly rows of one state, or of all, with the attributes of their place."""
    rows = profiles if state is None else profiles.where(named(state_col) == state)
    rows = rows.dropna(subset=[key])
    joined = places.join(rows, key, "inner")
    return joined.withColumn(key, named(key).cast("string"))


def snapshot(df: DataFrame, moment: datetime | str, time_col: str = TIME) -> DataFrame:
    """All rows of one moment."""
    return df.where(named(time_col) == F.lit(str(moment)).cast(df.schema[time_col].dataType))


def numbered_times(times: DataFrame, time_col: str = TIME) -> DataFrame:
    """Distinct times numbered 0, 1, 2, ... in order.

    Times are numbered within their month, and the months are counted up; so no task sorts
    more than the distinct times of one month or one row per month.
    """
    block = F.date_trunc("month", named(time_col))
    distinct = times.select(named(time_col)).distinct().withColumn("__block", block)
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = distinct.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select(
        "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset")
    )
    within = Window.partitionBy("__block").orderBy(named(time_col))
    place = distinct.withColumn("__rank", F.row_number().over(within) - 1)
    return place.join(offsets, "__block").select(
        named(time_col), (F.col("__offset") + F.col("__rank")).alias("frame")
    )


def frames(
    profiles: DataFrame,
    places: DataFrame,
    column: str,
    start: datetime | str,
    end: datetime | str,
    key: str = FIPS,
    time_col: str = TIME,
) -> DataFrame:
    """Rows between two moments with their place, frame number and frame title."""
    kind = profiles.schema[time_col].dataType
    bounds = [F.lit(str(b)).cast(kind) for b in (start, end)]
    rows = profiles.where(named(time_col).between(*bounds)).select(
        named(key), named(time_col), named(column)
    )
    shown = rows.join(places, key, "inner")
    present = rows.join(places.select(named(key)).distinct(), key, "left_semi")
    numbers = numbered_times(present, time_col)
    title = F.concat(
        F.lit(f"{title_words(column)} "), named(time_col).cast("string"), F.lit(" UTC")
    )
    return (
        shown.join(numbers, time_col)
        .withColumn(key, named(key).cast("string"))
        .withColumn("frame_title", title)
    )


def headers_of(
    places: DataFrame, place_col: str = "place_name", state_col: str = "state"
) -> list[str]:
    """The column names of a wide table, in order, from the table of places alone.

    A job over the places, which are few beside the hourly rows and whose number is that of
    the columns asked for; the hourly rows are not read.
    """
    found = places.select(place_header(place_col, state_col).alias("header")).distinct()
    return sorted(r["header"] for r in found.where("header IS NOT NULL").collect())


def wide(
    df: DataFrame,
    headers: Sequence[str],
    measures: Sequence[str] = MEASURES,
    time_cols: Sequence[str] = TIME_COLUMNS,
    place_col: str = "place_name",
    state_col: str = "state",
) -> DataFrame:
    """One row per time, one column per ``place__state`` (and measure, if several).

    ``headers`` names the columns (``headers_of`` takes them from a table of places), so
    nothing runs before the result is read, and the hourly rows are read once. A row of a place
    beyond them fails the query, as do a time and place that occur twice.
    """
    header = place_header(place_col, state_col)
    beyond = F.raise_error(F.concat(F.lit("not among the headers: "), header)).cast("string")
    slim = df.select(
        *[named(c) for c in time_cols],
        F.when(header.isNull() | header.isin(list(headers)), header).otherwise(beyond).alias("__header"),
        *[named(m) for m in measures],
    ).where("__header IS NOT NULL")
    cells = [only_value(m, f"{m}: time and place repeat").alias(m) for m in measures]
    return slim.groupBy(*time_cols).pivot("__header", list(headers)).agg(*cells)


def wide_measure(
    combined: DataFrame,
    measure: str,
    measures: Sequence[str] = MEASURES,
    time_cols: Sequence[str] = TIME_COLUMNS,
) -> DataFrame:
    """The columns of one measure out of a wide table of several, in time order."""

    def owner(column: str) -> str | None:
        return max((m for m in measures if column.endswith(f"_{m}")), key=len, default=None)

    own = [c for c in combined.columns if c not in time_cols and owner(c) == measure]
    times = [named(c) for c in time_cols]
    cells = [named(c).alias(c.removesuffix(f"_{measure}")) for c in own]
    return combined.select(*times, *cells).orderBy(*times)


def histogram(
    df: DataFrame,
    value: str,
    bins: int = 100,
    low: float = 0.0,
    high: float = 1.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Row count per bin, empty bins included, with the largest value of the group.

    Null values and values outside the range fall in no bin; the maximum spans all values.
    Counts per bin are formed before the groups are brought together, so a group arrives
    as at most ``bins + 1`` rows.
    """
    binned = df.select(
        *[named(b) for b in by],
        named(value).cast("double").alias("__value"),
        bin_index(value, bins, low, high).alias("__bin"),
    )
    counts = binned.groupBy(*by, "__bin").agg(
        F.count(F.lit(1)).alias("__n"), F.max("__value").alias("__max")
    )
    filled = F.when(F.col("__bin").isNotNull(), F.struct("__bin", "__n"))
    groups = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(filled)).alias("__hist"),
        F.max("__max").alias("max_value"),
    )
    edges = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    step = (high - low) / bins
    return groups.select(*by, edges, "__hist", "max_value").select(
        *by,
        "bin",
        (F.col("bin") * F.lit(step) + F.lit(float(low))).alias("bin_start"),
        F.coalesce(F.try_element_at("__hist", F.col("bin")), F.lit(0)).alias("n"),
        "max_value",
    )


# The words of the titles.
def histogram_title(
    place: Column | str, state: Column | str, generation_type: str, maximum: Column | str
) -> Column:
    place, state = [F.col(c) if isinstance(c, str) else c for c in (place, state)]
    return F.concat(
        F.lit("county: "), place, F.lit("; state: "), state,
        F.lit(f"; gen: {generation_type}; max:"), fixed(maximum, 2),
    )


def county_histograms(
    profiles: DataFrame,
    generation_type: str,
    fips: str | None = None,
    key: str = FIPS,
    place_col: str = "place_name",
    state_col: str = "state",
    time_col: str = TIME,
    prefix: str = MEASURE_PREFIX,
) -> DataFrame:
    """Histogram of one measure for a county, or for each, with its title.

    The title holds the earliest name of the county.
    """
    rows = profiles if fips is None else profiles.where(named(key) == fips)
    # One pass: counts per bin and name, from which histogram, largest value and name follow.
    bins, low, high = 100, 0.0, 1.0
    value = f"{prefix}{generation_type}"
    counts = (
        rows.where(named(key).isNotNull())
        .select(
            named(key),
            named(place_col).alias("__place"),
            named(state_col).alias("__state"),
            named(time_col).alias("__time"),
            named(value).cast("double").alias("__value"),
            bin_index(value, bins, low, high).alias("__bin"),
        )
        .groupBy(key, "__place", "__state", "__bin")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.max("__value").alias("__max"),
            F.min("__time").alias("__since"),
        )
    )
    groups = counts.groupBy(key).agg(
        F.collect_list(F.when(F.col("__bin").isNotNull(), F.struct("__bin", "__n"))).alias("__hist"),
        F.max("__max").alias("max_value"),
        F.min(
            F.when(F.col("__since").isNotNull(), F.struct("__since", "__place", "__state"))
        ).alias("__first"),
    )
    edges = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    own = F.filter("__hist", lambda e: e["__bin"] == F.col("bin"))
    return groups.select(key, edges, "__hist", "max_value", "__first").select(
        key,
        "bin",
        (F.col("bin") * F.lit((high - low) / bins) + F.lit(low)).alias("bin_start"),
        F.aggregate(own, F.lit(0).cast("long"), lambda n, e: n + e["__n"]).alias("n"),
        "max_value",
        histogram_title("__first.__place", "__first.__state", generation_type, "max_value").alias(
            "title"
        ),
    )


def mean_var_long(
    df: DataFrame,
    measures: Sequence[str] = GENERATION_TYPES,
    keys: Sequence[str] = STATISTIC_KEYS,
    prefix: str = MEASURE_PREFIX,
) -> DataFrame:
    """Mean and sample variance per key and measure, one row per measure.

    A measure without any statistic gives no row; rows with a null key do not count.
    """
    plain = strip_prefix(df, prefix).dropna(subset=list(keys))
    statistics = [
        f(named(m).cast("double")).alias(f"__{f.__name__}_{m}")
        for m in measures
        for f in (F.avg, F.var_samp)
    ]
    grouped = plain.groupBy(*keys).agg(*statistics)
    parts = []
    for m in measures:
        parts += [F.lit(m), named(f"__avg_{m}"), named(f"__var_samp_{m}")]
    rows = grouped.select(
        *[named(k) for k in keys],
        F.stack(F.lit(len(measures)), *parts).alias(
            "gen_type", "average_capacity_factor", "average_variance"
        ),
    )
    return rows.where("average_capacity_factor IS NOT NULL OR average_variance IS NOT NULL")


def _in_range(column: str, bounds: tuple[float, float] | None) -> list[Column]:
    return [] if bounds is None else [named(column).between(*bounds)]


def scatter_points(
    statistics: DataFrame,
    variance_range: tuple[float, float] | None = None,
    chosen_types: Sequence[str] = (),
) -> DataFrame:
    """Points of the chosen types, flagged where their variance lies in the interval.

    No interval, or no type, chosen means all.
    """
    chosen = [named("gen_type").isin(list(chosen_types))] if chosen_types else []
    inside = F.coalesce(all_of(_in_range("average_variance", variance_range)), F.lit(False))
    return statistics.where(all_of(chosen)).withColumn("in_range", inside)


def brushed_average(
    statistics: DataFrame,
    variance_range: tuple[float, float] | None = None,
    chosen_types: Sequence[str] = (),
) -> DataFrame:
    """Average of the averages by type over points in the variance interval and above 0.

    Every type keeps its bar; ``chosen`` tells the types picked, all if none was picked.
    """
    kept = statistics.where(
        all_of(
            [named("average_capacity_factor") > 0, *_in_range("average_variance", variance_range)]
        )
    )
    chosen = named("gen_type").isin(list(chosen_types)) if chosen_types else F.lit(True)
    return (
        kept.groupBy("gen_type")
        .agg(F.avg("average_capacity_factor").alias("average_capacity_factor"))
        .withColumn("chosen", chosen)
    )
