"""The area-change analysis from raw table to series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.columns import lower_strings
from ..operators import change as op
from ..sources.storage import stored


def analyse_area(
    summary: DataFrame,
    entity: str = op.RESPONDENT,
    name: str = op.NAME,
    demand: str = "demand_annual_mwh",
    area: str = "area_km2",
    order: Sequence[str] = ("report_date",),
    min_change_percent: float = op.MIN_CHANGE_PERCENT,
    min_shown_demand: float = op.MIN_SHOWN_DEMAND,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Changed entities, one row each, and their series over time.

    The changed entities are found once: they are stored below ``folder`` if one is named, else
    the plan stays lazy and their uses share one shuffle.
    """
    lowered = lower_strings(summary)
    changed = op.area_changes(lowered, entity, name, demand, area, order, min_change_percent)
    changed = op.shared_changes(changed, entity) if folder is None else stored(changed, folder)
    series = op.area_change_series(lowered, changed, entity, area, order, min_shown_demand)
    return changed, series
