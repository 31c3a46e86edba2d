"""The forecast-bias analysis from raw tables to curve."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..functions.columns import lower_strings
from ..operators import forecast as op
from ..sources.storage import stored


def realized_demand(
    hourly: DataFrame, demand_col: str, folder: str | None = None
) -> DataFrame:
    """Peak and total per respondent and year, stored below ``folder`` if one is named.

    The hourly table is scanned once either way: all that follows reads the stored rows or,
    without a folder, where the plan stays lazy, shares one shuffle of the yearly figures.
    """
    realized = op.realized(hourly, demand_col)
    return op.shared_years(realized) if folder is None else stored(realized, folder)


@dataclass(frozen=True)
class BiasAnalysis:
    """One analysis; each result is a DataFrame made when first asked for.

    ``demand`` comes from ``realized_demand``.
    """

    forecast: DataFrame
    demand: DataFrame
    respondents: DataFrame
    end_weighting: str = "total"
    first_year: int = op.FIRST_YEAR
    last_year: int = op.LAST_YEAR
    load_weight_year: int = op.LOAD_WEIGHT_YEAR
    years_to_drop: Collection[int] = ()
    mean_annual_demand_threshold: float = 0

    @cached_property
    def errors(self) -> DataFrame:
        """Error per respondent, report year and forecast year."""
        return op.forecast_errors(
            self.forecast,
            self.demand,
            lower_strings(self.respondents),
            self.first_year,
            self.last_year,
            self.years_to_drop,
            self.mean_annual_demand_threshold,
        )

    @cached_property
    def bias(self) -> DataFrame:
        """Mean error per respondent, one column per lookahead."""
        return op.forecast_bias(self.errors)

    @cached_property
    def curve(self) -> DataFrame:
        """Mean error over respondents, weighted by demand."""
        return op.weighted_bias(
            self.bias, self.demand, self.end_weighting, self.load_weight_year
        )

    @cached_property
    def coverage(self) -> DataFrame:
        """Respondents and demand that pass the size rule."""
        return op.coverage(
            self.forecast,
            self.demand,
            self.first_year,
            self.last_year,
            self.mean_annual_demand_threshold,
        )
