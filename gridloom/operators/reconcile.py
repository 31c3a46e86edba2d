"""Reported figures beside the figures they should equal."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column, named, sum0
from ..functions.sharing import kept_whole

AUTHORITY = "balancing_authority_code_eia"
TIME = "datetime_utc"
KEYS = (AUTHORITY, TIME)

# The demand measures of one series extract.
DEMAND_MEASURES = (
    "demand_reported_mwh",
    "demand_adjusted_mwh",
    "demand_imputed_eia_mwh",
    "demand_forecast_mwh",
)


def sum_of_parts(
    parts: DataFrame, keys: Sequence[str], part_col: str, alias: str = "calculated"
) -> DataFrame:
    """Sum per key; rows with a null key do not count, a group of nulls sums to 0."""
    return parts.dropna(subset=list(keys)).groupBy(*keys).agg(sum0(part_col).alias(alias))


def shared_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations present on both sides.

    Both sides become distinct first, so a frequent key meets the join as one row.
    """
    sides = [df.select(*[named(k) for k in keys]).dropna().distinct() for df in (left, right)]
    return sides[0].join(sides[1], list(keys), "left_semi")


def reconcile(
    total: DataFrame,
    parts: DataFrame,
    keys: Sequence[str] = KEYS,
    total_col: str = "net_generation_reported_mwh",
    part_col: str = "net_generation_reported_mwh",
    complete_grid: bool = False,
) -> DataFrame:
    """Reported total beside the sum of its parts, matched on the keys.

    With ``complete_grid`` the parts count as 0 wherever every single key value occurs
    somewhere in the parts but the combination does not. Only the grid cells that a total
    row asks for are ever made.
    """
    keys = list(keys)
    reported = total.select(*[named(k) for k in keys], named(total_col).alias("reported"))
    if not complete_grid:
        return reported.join(sum_of_parts(parts, keys, part_col), keys, "inner")

    # The parts are summed once, rows with a null key too, whose other keys still count. A
    # cell that the parts hold needs no look at its single keys.
    sums = parts.groupBy(*map(named, keys)).agg(sum0(part_col).alias("calculated"))
    sums = kept_whole(sums, keys)
    matched = reported.join(sums.dropna(subset=keys), keys, "left")
    empty = matched.where("calculated IS NULL")
    for key in keys:
        empty = empty.join(sums.select(named(key)).dropna().distinct(), key, "left_semi")
    zero = F.coalesce("calculated", F.lit(0)).alias("calculated")
    return (
        matched.where("calculated IS NOT NULL")
        .unionByName(empty.select(*keys, "reported", "calculated"))
        .select(*keys, "reported", zero)
    )


def identity_check(
    df: DataFrame,
    reported: Column | str = "demand_reported_mwh",
    minuend: Column | str = "net_generation_reported_mwh",
    subtrahend: Column | str = "interchange_reported_mwh",
    label: str = AUTHORITY,
) -> DataFrame:
    """Reported figure beside ``minuend - subtrahend``, one row per labelled input row."""
    return df.where(named(label).isNotNull()).select(
        named(label).alias("label"),
        as_column(reported).alias("reported"),
        (as_column(minuend) - as_column(subtrahend)).alias("calculated"),
    )


def series_extract(
    df: DataFrame,
    entity: str,
    start: datetime | str,
    end: datetime | str,
    measures: Sequence[str] = DEMAND_MEASURES,
    entity_col: str = AUTHORITY,
    time_col: str = TIME,
    long: bool = False,
) -> DataFrame:
    """Measures of one entity between two moments, both included.

    Midnight as the end keeps only the first hour of the last day. ``long`` gives one row
    per time and measure, null values kept.
    """
    kind = df.schema[time_col].dataType
    bounds = [F.lit(str(b)).cast(kind) for b in (start, end)]
    rows = df.where((named(entity_col) == entity) & named(time_col).between(*bounds)).select(
        named(time_col), *[named(m) for m in measures]
    )
    if not long:
        return rows
    return rows.unpivot([time_col], list(measures), "series", "value")
