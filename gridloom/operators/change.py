"""Entities whose size changes strongly over time, and entity look-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named, percent_change, strip_ws
from ..functions.sharing import kept_whole
from .forecast import NAME, RESPONDENT

# Least change in percent, least mean demand for display.
MIN_CHANGE_PERCENT = 10
MIN_SHOWN_DEMAND = 10**7


def area_changes(
    df: DataFrame,
    entity: str = RESPONDENT,
    name: str = NAME,
    demand: str = "demand_annual_mwh",
    area: str = "area_km2",
    order: Sequence[str] = ("report_date",),
    min_change_percent: float = MIN_CHANGE_PERCENT,
) -> DataFrame:
    """Entities whose area changed by more than the limit between first and last known area.

    Entities need a mean demand, kept as a whole number. A first area of 0 gives no change
    and drops the entity.
    """
    # The value itself orders rows of the same moment, so that ties give one answer.
    when = F.struct(*[named(c) for c in order])
    when_known = F.when(
        named(area).isNotNull(), F.struct(*[named(c) for c in order], named(area).alias("__tie"))
    )
    by_name = (
        df.where(named(entity).isNotNull())
        .groupBy(named(entity), named(name).alias("__name"))
        .agg(
            F.min(when).alias("__since"),
            F.sum(named(demand)).alias("__demand"),
            F.count(named(demand)).alias("__n"),
            F.min(when_known).alias("__first"),
            F.max(when_known).alias("__last"),
            F.min_by(named(area), when_known).alias("__first_area"),
            F.max_by(named(area), when_known).alias("__last_area"),
        )
    )
    mean = F.try_divide(F.sum("__demand"), F.sum("__n"))
    firsts = by_name.groupBy(entity).agg(
        strip_ws(F.min_by("__name", F.struct("__since", "__name"))).alias("name"),
        mean.cast("long").alias("demand"),
        F.min_by("__first_area", "__first").alias("first_area"),
        F.max_by("__last_area", "__last").alias("last_area"),
    )
    return (
        firsts.where("demand IS NOT NULL")
        .withColumn("pct_change", percent_change("first_area", "last_area"))
        .where(F.abs("pct_change") > min_change_percent)
    )


def shared_changes(changed: DataFrame, entity: str = RESPONDENT) -> DataFrame:
    """Changed entities of which every use reads one evaluation; one row per entity."""
    return kept_whole(changed, [entity], [entity])


def area_change_series(
    df: DataFrame,
    changed: DataFrame,
    entity: str = RESPONDENT,
    area: str = "area_km2",
    order: Sequence[str] = ("report_date",),
    min_shown_demand: float = MIN_SHOWN_DEMAND,
) -> DataFrame:
    """Percent change since the first area, with an opacity that grows with demand.

    ``changed`` is the result of ``area_changes``. The gradient runs over
    all changed entities in log10 of demand; the display limit comes after it. ``changed`` is
    used twice (``shared_changes`` gives a form that is evaluated once for both).
    """
    span = changed.agg(F.struct(F.min("demand").alias("low"), F.max("demand").alias("high")).alias("span"))
    span = span.scalar()
    low, high = F.log10(F.when(span["low"] > 0, span["low"])), F.log10(span["high"])
    shown = changed.withColumn(
        "gradient", F.try_divide(F.log10("demand") - low, high - low)
    ).where(F.col("demand") >= min_shown_demand)
    points = df.where(named(area).isNotNull()).select(
        named(entity), *[named(c) for c in order], named(area)
    )
    return points.join(
        shown.select(entity, "name", "demand", "first_area", "gradient"), entity
    ).select(
        entity,
        "name",
        *order,
        "demand",
        percent_change("first_area", area).alias("pct_change"),
        "gradient",
        F.pow("gradient", F.lit(2)).alias("alpha"),
    )


def lookup_by_id(df: DataFrame, identity: int | str, entity: str = RESPONDENT) -> DataFrame:
    return df.where(named(entity) == identity)


def lookup_by_name(
    df: DataFrame, pattern: str, entity: str = RESPONDENT, name: str = NAME
) -> DataFrame:
    """Distinct entities whose name holds the pattern; a missing name never matches."""
    return df.where(named(name).rlike(pattern)).select(named(entity), named(name)).distinct()
