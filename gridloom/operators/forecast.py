"""Peak-demand forecasts against the demand that came true."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import max_strict, named, null_or, relative_error, strip_ws, sum0
from ..functions.guards import only_value, unique_rows
from ..functions.labels import percent
from ..functions.sharing import kept_whole

RESPONDENT = "respondent_id_ferc714"
NAME = "respondent_name_ferc714"

# Years covered, weight year, lookaheads shown.
FIRST_YEAR = 2006
LAST_YEAR = 2024
LOAD_WEIGHT_YEAR = 2015
LOOKAHEADS = range(11)

# Limits of the outlier rules.
MAX_FIRST_YEAR_ERROR = 100
MAX_MISSING_LOOKAHEADS = 5
MAX_MEAN_ERROR_AT_1 = 0.3
MAX_MEAN_ERROR_AT_10 = 1.0


def bias_column(lookahead: int) -> str:
    return f"lookahead_{lookahead}"


def realized(
    hourly: DataFrame,
    demand_col: str,
    respondent: str = RESPONDENT,
    time_col: str = "datetime_utc",
    report_date: str = "report_date",
) -> DataFrame:
    """Realized peak and total demand per respondent and year, in one aggregation.

    Rows whose year of time differs from the year of their report do not count.
    """
    year = F.year(named(report_date))
    return (
        hourly.where((F.year(named(time_col)) == year) & named(respondent).isNotNull())
        .groupBy(named(respondent), year.alias("year"))
        .agg(
            F.max(named(demand_col)).alias("realized_peak"),
            sum0(demand_col).alias("realized_total_demand"),
        )
    )


def shared_years(realized_demand: DataFrame, respondent: str = RESPONDENT) -> DataFrame:
    """Realized demand of which every use reads one aggregation of the hourly table.

    The years of a respondent meet in one list. Tests on the respondent still reach the scan.
    """
    return kept_whole(realized_demand, [respondent], [respondent])


def peak_forecasts(
    forecast: DataFrame,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
    summer: str = "summer_peak_demand_forecast_mw",
    winter: str = "winter_peak_demand_forecast_mw",
    respondent: str = RESPONDENT,
) -> DataFrame:
    """Yearly peak forecast (the larger season) and its lookahead, for a range of report years."""
    return forecast.where(named("report_year").between(first_year, last_year)).select(
        named(respondent),
        "report_year",
        "forecast_year",
        (F.col("forecast_year") - F.col("report_year")).alias("lookahead"),
        max_strict(summer, winter).alias("forecast"),
    )


def respondent_name_table(
    respondents: DataFrame, respondent: str = RESPONDENT, name: str = NAME
) -> DataFrame:
    """One row per respondent; two names for one id fail the query."""
    return (
        respondents.select(named(respondent), named(name))
        .distinct()
        .groupBy(named(respondent))
        .agg(only_value(name, "a respondent has two names").alias(name))
    )


def match_realized(
    forecasts: DataFrame,
    realized_demand: DataFrame,
    respondent: str = RESPONDENT,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Forecasts whose forecast year has realized demand, with the realized peak.

    A respondent and year that occur twice in the realized demand fail the query.
    """
    twice = "realized demand repeats a respondent and year"
    peaks = realized_demand.select(
        named(respondent), F.col("year").alias("forecast_year"), "realized_peak", *map(named, carried)
    )
    peaks = unique_rows(peaks, [respondent, "forecast_year"], twice)
    return forecasts.join(peaks, [respondent, "forecast_year"], "inner")


def large_respondents(
    realized_demand: DataFrame, threshold: float, respondent: str = RESPONDENT
) -> DataFrame:
    """Mean yearly total of each respondent and whether it reaches the threshold."""
    return (
        realized_demand.groupBy(named(respondent))
        .agg(F.avg("realized_total_demand").alias("mean_yearly_total_demand"))
        .withColumn(
            "large", (F.col("mean_yearly_total_demand") >= threshold) | F.lit(threshold == 0)
        )
    )


def forecast_errors(
    forecast: DataFrame,
    realized_demand: DataFrame,
    respondents: DataFrame,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
    years_to_drop: Collection[int] = (),
    mean_annual_demand_threshold: float = 0,
    respondent: str = RESPONDENT,
    name: str = NAME,
) -> DataFrame:
    """Relative error per respondent, report year and forecast year.

    ``years_to_drop`` are forecast years. A threshold of 0 keeps every respondent. A
    forecast or peak that is zero or missing counts as error 0.
    """
    forecasts = peak_forecasts(forecast, first_year, last_year, respondent=respondent)
    if years_to_drop:
        forecasts = forecasts.where(~F.col("forecast_year").isin(list(years_to_drop)))
    # Names and the size rule go onto the realized side, where a respondent has one row per
    # year; forecasts then join on respondent and year only.
    demand = realized_demand
    if mean_annual_demand_threshold != 0:
        kept = large_respondents(realized_demand, mean_annual_demand_threshold, respondent)
        demand = demand.join(kept.where("large").select(respondent), respondent, "left_semi")
    names = respondent_name_table(respondents, respondent, name)
    demand = demand.join(names, respondent, "left")
    return match_realized(forecasts, demand, respondent, [name]).select(
        named(respondent),
        named(name),
        "report_year",
        "forecast_year",
        "lookahead",
        "forecast",
        "realized_peak",
        relative_error("forecast", "realized_peak").alias("error"),
    )


def forecast_bias(
    errors: DataFrame, respondent: str = RESPONDENT, name: str = NAME
) -> DataFrame:
    """Mean error per named respondent, one column for each lookahead 0 to 10.

    A report year whose one-year error reaches 100 is left out. Then respondents are left
    out that lack more than five of the lookaheads found in ``errors`` (0 counts as
    present), or whose mean error is too large at lookahead 1 or 10. A report year with
    two forecasts for one lookahead fails the query.
    """
    report = Window.partitionBy(named(respondent), "report_year")
    before = F.lag("lookahead").over(report.orderBy("lookahead"))
    at_one = F.max(F.when(F.col("lookahead") == 1, F.col("error"))).over(report)
    single = F.when(
        before == F.col("lookahead"), F.raise_error(F.lit("a lookahead repeats in a report year"))
    ).otherwise(F.col("error"))
    usable = null_or(F.col("__at_one") < MAX_FIRST_YEAR_ERROR, "__at_one")
    counts = usable & named(respondent).isNotNull() & named(name).isNotNull()
    # A respondent's errors are few, one per report year and lookahead: brought together once,
    # they serve the windows and the means.
    rows = errors.repartition(named(respondent)).select(
        named(respondent),
        named(name),
        F.when(F.col("lookahead") != 0, F.col("lookahead")).alias("__ahead"),
        single.alias("error"),
        at_one.alias("__at_one"),
    )
    # Lookaheads without a usable error travel along, as they are found all the same: the
    # figures and the set of all lookaheads come from one evaluation.
    by_respondent = rows.groupBy(respondent, name).agg(
        F.count_if(counts).alias("__n"),
        F.lit(0.0).alias(bias_column(0)),
        *[
            F.avg(F.when(counts & (F.col("__ahead") == k), F.col("error"))).alias(bias_column(k))
            for k in LOOKAHEADS
            if k != 0
        ],
        F.collect_set(F.when(counts, F.col("__ahead"))).alias("__present"),
        F.collect_set("__ahead").alias("__found"),
    )
    by_respondent = kept_whole(by_respondent, [respondent, name])
    found = (
        by_respondent.select(F.explode("__found").alias("lookahead"))
        .agg(F.count_distinct("lookahead").alias("n"))
        .scalar()
    )
    at_1, at_10 = bias_column(1), bias_column(10)
    return (
        by_respondent.where("__n > 0")
        .where(found - F.size("__present") <= MAX_MISSING_LOOKAHEADS)
        .where(null_or(F.abs(F.col(at_1)) <= MAX_MEAN_ERROR_AT_1, at_1))
        .where(null_or(F.abs(F.col(at_10)) <= MAX_MEAN_ERROR_AT_10, at_10))
        .drop("__n", "__present", "__found")
    )


def bias_long(bias: DataFrame, respondent: str = RESPONDENT) -> DataFrame:
    """The same figures with one row per respondent and lookahead, nulls kept."""
    pairs = ", ".join(f"{k}, {bias_column(k)}" for k in LOOKAHEADS)
    rows = F.expr(f"stack({len(LOOKAHEADS)}, {pairs})").alias("lookahead", "error")
    return bias.select(named(respondent), rows)


def weighted_bias(
    bias: DataFrame,
    realized_demand: DataFrame,
    end_weighting: str = "total",
    load_weight_year: int = LOAD_WEIGHT_YEAR,
    respondent: str = RESPONDENT,
) -> DataFrame:
    """Error curve over lookaheads 0 to 10, weighted by the demand of one year.

    Respondents without demand in that year do not count. A missing error adds nothing to
    the sum, yet its weight stays in the divisor.
    """
    weights = {"peak": "realized_peak", "total": "realized_total_demand"}
    if end_weighting not in weights:
        raise ValueError("end_weighting must be 'peak' or 'total'")
    weight = (
        realized_demand.where(F.col("year") == load_weight_year)
        .groupBy(named(respondent))
        .agg(only_value(weights[end_weighting], "realized demand repeats").alias("__weight"))
    )
    sums = bias.join(weight, respondent, "inner").agg(
        sum0("__weight").alias("__all"),
        *[
            F.expr(f"coalesce(sum({c} * __weight), 0)").alias(c)
            for c in map(bias_column, LOOKAHEADS)
        ],
    )
    pairs = ", ".join(f"{k}, try_divide({bias_column(k)}, __all)" for k in LOOKAHEADS)
    rows = F.expr(f"stack({len(LOOKAHEADS)}, {pairs})")
    curve = sums.select(rows.alias("lookahead", "weighted_error"))
    return curve.select(
        "lookahead",
        "weighted_error",
        F.when(F.col("lookahead") > 0, percent(F.col("weighted_error") * 100, 1)).alias("label"),
    )


def coverage(
    forecast: DataFrame,
    realized_demand: DataFrame,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
    mean_annual_demand_threshold: float = 0,
    respondent: str = RESPONDENT,
) -> DataFrame:
    """Respondents with a checked forecast before and after the size rule, and demand kept.

    The share is over all respondents with demand; dropped years play no part.
    """
    forecasts = peak_forecasts(forecast, first_year, last_year, respondent=respondent)
    checked = match_realized(forecasts, realized_demand, respondent)
    checked = checked.select(named(respondent), F.lit(True).alias("checked")).distinct()
    sizes = large_respondents(realized_demand, mean_annual_demand_threshold, respondent)
    mean = F.col("mean_yearly_total_demand")
    return sizes.join(checked, respondent, "left").agg(
        F.count("checked").alias("n_before"),
        F.count(F.when(F.col("large"), F.col("checked"))).alias("n_after"),
        (F.try_divide(sum0(F.when(F.col("large"), mean)), F.sum(mean)) * 100).alias(
            "percent_of_demand"
        ),
    )


def coverage_text(figures: DataFrame) -> DataFrame:
    """One line of text from the coverage figures."""
    return figures.select(
        F.concat(
            F.lit("showing "), F.col("n_after").cast("string"), F.lit(" / "),
            F.col("n_before").cast("string"), F.lit(" respondents ("),
            percent("percent_of_demand", 2), F.lit(" of total demand)"),
        ).alias("text")
    )


def respondent_names(
    respondents: DataFrame,
    respondent: str = RESPONDENT,
    name: str = NAME,
    order: str = "report_date",
) -> DataFrame:
    """One stripped name per respondent: of its names, the one that went out of use first."""
    last_use = (
        respondents.where(named(respondent).isNotNull())
        .groupBy(named(respondent), named(name))
        .agg(F.max(named(order)).alias("__last"))
    )
    return last_use.groupBy(respondent).agg(
        strip_ws(F.min_by(named(name), F.struct("__last", named(name)))).alias("name")
    )


def respondent_curves(
    forecast: DataFrame,
    realized_demand: DataFrame,
    respondents: DataFrame,
    ids: Sequence[int] | None = None,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
    years_to_drop: Collection[int] = (),
    respondent: str = RESPONDENT,
    name: str = NAME,
    order: str = "report_date",
) -> DataFrame:
    """Error curve of each report year of the given respondents, or of all.

    Every report year gets one more row at lookahead 0 with error 0, otherwise a copy of
    its first row by lookahead. ``gradient`` spreads the report years of a respondent
    evenly from 0 to 1.
    """
    if ids is not None:
        forecast, realized_demand, respondents = [
            df.where(named(respondent).isin(list(ids)))
            for df in (forecast, realized_demand, respondents)
        ]
    forecasts = peak_forecasts(forecast, first_year, last_year, respondent=respondent)
    if years_to_drop:
        forecasts = forecasts.where(~F.col("forecast_year").isin(list(years_to_drop)))
    points = match_realized(forecasts, realized_demand, respondent).select(
        named(respondent),
        "report_year",
        "forecast_year",
        "lookahead",
        "forecast",
        "realized_peak",
        relative_error("forecast", "realized_peak").alias("error"),
    )

    copied = ["forecast_year", "forecast", "realized_peak"]
    first_row = F.min_by(F.struct(*copied), F.struct("lookahead", *copied))
    # One row per report year, so a respondent's window holds last_year - first_year + 1 rows.
    evenly = Window.partitionBy(respondent).orderBy("report_year")
    years = (
        points.groupBy(respondent, "report_year")
        .agg(first_row.alias("__first"))
        .withColumn("gradient", F.percent_rank().over(evenly))
        .join(respondent_names(respondents, respondent, name, order), respondent, "left")
    )
    anchors = years.select(
        respondent,
        "report_year",
        "__first.forecast_year",
        F.lit(0).cast(points.schema["lookahead"].dataType).alias("lookahead"),
        "__first.forecast",
        "__first.realized_peak",
        F.lit(0.0).alias("error"),
        "gradient",
        "name",
    )
    return points.join(years.drop("__first"), [respondent, "report_year"]).unionByName(anchors)


def trajectory(
    forecast: DataFrame,
    forecast_col: str = "winter_peak_demand_forecast_mw",
    ids: Sequence[int] | None = None,
    report_year: int | None = None,
    scale: float = 1000,
    respondent: str = RESPONDENT,
) -> DataFrame:
    """Forecast by forecast year, in units of ``scale``, for one report or for all."""
    tests: list[Column] = []
    if ids is not None:
        tests.append(named(respondent).isin(list(ids)))
    if report_year is not None:
        tests.append(F.col("report_year") == report_year)
    for test in tests:
        forecast = forecast.where(test)
    return forecast.select(
        named(respondent),
        "report_year",
        "forecast_year",
        (named(forecast_col) / F.lit(scale)).alias("forecast_scaled"),
    ).orderBy(respondent, "report_year", "forecast_year")
