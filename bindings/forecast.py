"""Forecast errors and area changes: suppliers and customers as respondents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import change
from gridloom.operators import forecast as op
from gridloom.plans.area import analyse_area
from gridloom.plans.bias import BiasAnalysis, realized_demand
from gridloom.sources.storage import shared_folder

from .common import (
    DEMAND_SQL,
    forecasts_from,
    hourly_demand,
    read,
    register,
    respondents,
    tidy,
)

THRESHOLD = 660_000
YEARS_TO_DROP = (1999,)

ERRORS_SQL = f"""{DEMAND_SQL},
sizes AS (SELECT rid, avg(total) AS m FROM realized GROUP BY rid),
checked AS (
  SELECT f.rid, report_year, forecast_year, forecast_year - report_year AS lookahead,
    CASE WHEN summer IS NOT NULL AND winter IS NOT NULL THEN greatest(summer, winter) END
      AS forecast, peak
  FROM forecast f JOIN realized r ON f.rid = r.rid AND forecast_year = r.yr),
errors AS (
  SELECT checked.*, lower(s_name) AS name,
    coalesce(CASE WHEN forecast <> 0 AND peak <> 0 THEN (forecast - peak) / peak END, 0e0) AS e
  FROM checked LEFT JOIN supplier ON rid = s_suppkey
  WHERE forecast_year <> 1999 AND rid IN (SELECT rid FROM sizes WHERE m >= {THRESHOLD}))"""

BIAS_SQL = f"""{ERRORS_SQL},
flagged AS (
  SELECT *, max(CASE WHEN lookahead = 1 THEN e END) OVER (PARTITION BY rid, report_year) AS one
  FROM errors),
means AS (
  SELECT rid, name, lookahead, avg(e) AS e FROM flagged
  WHERE (one < 100 OR one IS NULL) AND name IS NOT NULL GROUP BY ALL),
bias AS (
  SELECT rid, name, 0e0 AS lookahead_0,
    {", ".join(f"max(CASE WHEN lookahead = {k} THEN e END) AS lookahead_{k}"
               for k in range(1, 11))}
  FROM means GROUP BY ALL
  HAVING (SELECT count(DISTINCT lookahead) FROM errors WHERE lookahead <> 0)
    - count(CASE WHEN lookahead <> 0 THEN 1 END) <= 5),
kept AS (
  SELECT * FROM bias WHERE (lookahead_1 IS NULL OR abs(lookahead_1) <= 3e-1)
    AND (lookahead_10 IS NULL OR abs(lookahead_10) <= 1))"""


def _curve_sql(weight: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {k} AS k, coalesce(sum(lookahead_{k} * w), 0) / sum(w) AS c FROM weighted"
        for k in range(11)
    )
    return f"""WITH {BIAS_SQL},
    weighted AS (
      SELECT kept.*, {weight} AS w FROM kept JOIN realized USING (rid) WHERE yr = 1998)
    SELECT CAST(k AS INTEGER) AS lookahead, round(c, 6) + 0e0 AS weighted_error,
      CASE WHEN k > 0 THEN printf('%.1f', c * 100 + 0e0) || '%' END AS label
    FROM ({rows})"""


def _demand_and_forecast(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    hourly = hourly_demand(spark, folder)
    demand = realized_demand(hourly, "demand_mwh", shared_folder(spark))
    return demand, forecasts_from(demand)


def _analysis(spark: SparkSession, folder: str, weighting: str = "total") -> BiasAnalysis:
    demand, forecast = _demand_and_forecast(spark, folder)
    return BiasAnalysis(
        forecast,
        demand,
        respondents(spark, folder),
        end_weighting=weighting,
        first_year=1995,
        last_year=2000,
        load_weight_year=1998,
        years_to_drop=YEARS_TO_DROP,
        mean_annual_demand_threshold=THRESHOLD,
    )


@register(
    "realized_peak_total",
    f"""WITH {DEMAND_SQL}
    SELECT rid AS respondent_id_ferc714, yr AS year, peak AS realized_peak,
      round(total, 2) AS realized_total_demand FROM realized""",
)
def realized_peak_total(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(op.realized(hourly_demand(spark, folder), "demand_mwh"), 2)


@register(
    "forecast_errors",
    f"""WITH {ERRORS_SQL}
    SELECT rid AS respondent_id_ferc714, name AS respondent_name_ferc714, report_year,
      forecast_year, lookahead, round(forecast, 4) AS forecast, peak AS realized_peak,
      round(e, 4) + 0e0 AS error FROM errors""",
)
def forecast_errors(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(_analysis(spark, folder).errors, 4)


@register(
    "forecast_bias",
    f"""WITH {BIAS_SQL}
    SELECT rid AS respondent_id_ferc714, k AS lookahead, round(e, 6) + 0e0 AS error FROM (
      {" UNION ALL ".join(f"SELECT rid, {k} AS k, lookahead_{k} AS e FROM kept"
                          for k in range(11))})""",
)
def forecast_bias(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(op.bias_long(_analysis(spark, folder).bias))


@register("weighted_bias", _curve_sql("total"))
def weighted_bias(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(_analysis(spark, folder).curve)


@register("weighted_bias_peak", _curve_sql("peak"))
def weighted_bias_peak(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(_analysis(spark, folder, "peak").curve)


@register(
    "coverage",
    f"""WITH {ERRORS_SQL},
    figures AS (
      SELECT (SELECT count(DISTINCT rid) FROM checked) AS n_before,
        (SELECT count(DISTINCT rid) FROM checked JOIN sizes USING (rid) WHERE m >= {THRESHOLD})
          AS n_after,
        (SELECT sum(CASE WHEN m >= {THRESHOLD} THEN m END) / sum(m) * 100 FROM sizes) AS p)
    SELECT n_before, n_after, round(p, 6) AS percent_of_demand FROM figures""",
)
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(_analysis(spark, folder).coverage)


CURVES_SQL = f"""WITH {DEMAND_SQL},
    points AS (
      SELECT f.rid, report_year, forecast_year, forecast_year - report_year AS lookahead, peak,
        CASE WHEN summer IS NOT NULL AND winter IS NOT NULL THEN greatest(summer, winter) END
          AS forecast
      FROM forecast f JOIN realized r ON f.rid = r.rid AND forecast_year = r.yr
      WHERE forecast_year <> 1999),
    years AS (
      SELECT rid, report_year, percent_rank() OVER (PARTITION BY rid ORDER BY report_year) AS g
      FROM (SELECT DISTINCT rid, report_year FROM points)),
    curves AS (
      SELECT *, coalesce(CASE WHEN forecast <> 0 AND peak <> 0
        THEN (forecast - peak) / peak END, 0e0) AS e FROM points
      UNION ALL
      SELECT rid, report_year, forecast_year, 0, peak, forecast, 0e0 FROM (
        SELECT *, row_number() OVER (PARTITION BY rid, report_year ORDER BY lookahead) AS rn
        FROM points) WHERE rn = 1)
    SELECT rid AS respondent_id_ferc714, report_year, forecast_year, lookahead,
      round(forecast, 4) AS forecast, peak AS realized_peak, round(e, 4) + 0e0 AS error,
      round(g, 4) AS gradient, s_name AS name
    FROM curves JOIN years USING (rid, report_year) LEFT JOIN supplier ON rid = s_suppkey"""


@register("respondent_curves", CURVES_SQL)
def respondent_curves(spark: SparkSession, folder: str) -> DataFrame:
    demand, forecast = _demand_and_forecast(spark, folder)
    curves = op.respondent_curves(
        forecast,
        demand,
        respondents(spark, folder),
        first_year=1995,
        last_year=2000,
        years_to_drop=YEARS_TO_DROP,
    )
    return tidy(curves, 4)


ONE_RESPONDENT = 7


@register("respondent_curve_one", f"{CURVES_SQL} WHERE rid = {ONE_RESPONDENT}")
def respondent_curve_one(spark: SparkSession, folder: str) -> DataFrame:
    hourly = hourly_demand(spark, folder)
    demand = realized_demand(hourly, "demand_mwh")
    curves = op.respondent_curves(
        forecasts_from(demand),
        demand,
        respondents(spark, folder),
        ids=[ONE_RESPONDENT],
        first_year=1995,
        last_year=2000,
        years_to_drop=YEARS_TO_DROP,
    )
    return tidy(curves, 4)


@register(
    "trajectory",
    f"""WITH {DEMAND_SQL}
    SELECT rid AS respondent_id_ferc714, report_year, forecast_year,
      round(winter / 1000, 8) AS forecast_scaled FROM forecast""",
)
def trajectory(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(op.trajectory(_demand_and_forecast(spark, folder)[1]), 8)


MIN_SHOWN = 250_000

AREA_SQL = f"""
ranked AS (
  SELECT o_custkey AS id, o_totalprice AS a,
    o_orderdate AS day, o_orderkey AS seq,
    CAST(o_totalprice AS DECIMAL(18, 2)) AS exact,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS down
  FROM orders),
changed AS (
  SELECT id, lower(c_name) AS name, CAST(trunc(avg(exact)) AS BIGINT) AS demand,
    max(CASE WHEN up = 1 THEN a END) AS first_area,
    max(CASE WHEN down = 1 THEN a END) AS last_area
  FROM ranked JOIN customer ON id = c_custkey GROUP BY id, c_name),
listed AS (
  SELECT *, (last_area - first_area) / first_area * 100 AS pct_change FROM changed
  WHERE abs((last_area - first_area) / first_area * 100) > 10)"""


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = read(spark, folder, "orders"), read(spark, folder, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_custkey").alias("id"),
        F.concat(F.lit("\t "), "c_name", F.lit(" ")).alias("name"),
        # Customers order twice on some days; the order number tells which came first.
        F.col("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("a"),
        # Exact, so that a whole mean cannot fall just below itself before truncation.
        F.col("o_totalprice").cast("decimal(18,2)").alias("exact"),
    )


def _area(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    summary = _summary(spark, folder)
    return analyse_area(
        summary, "id", "name", "exact", "a", ["day", "seq"], min_shown_demand=MIN_SHOWN,
        folder=shared_folder(spark),
    )


@register(
    "area_change",
    f"""WITH {AREA_SQL}
    SELECT id, name, demand, first_area, last_area, round(pct_change, 4) AS pct_change
    FROM listed""",
)
def area_change(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(_area(spark, folder)[0], 4)


@register(
    "area_change_series",
    f"""WITH {AREA_SQL},
    span AS (SELECT log10(min(demand)) AS lo, log10(max(demand)) AS hi FROM listed),
    shown AS (
      SELECT listed.*, (log10(demand) - lo) / (hi - lo) AS g FROM listed, span
      WHERE demand >= {MIN_SHOWN})
    SELECT id, name, day, seq, demand, round((a - first_area) / first_area * 100, 4) + 0e0
      AS pct_change, round(g, 4) AS gradient, round(g * g, 4) AS alpha
    FROM ranked JOIN shown USING (id)""",
)
def area_change_series(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(_area(spark, folder)[1], 4)


@register(
    "lookup_by_name",
    """SELECT DISTINCT c_custkey AS id, c_name AS name FROM customer
    JOIN orders ON c_custkey = o_custkey WHERE regexp_matches(c_name, '(7|13)$')""",
)
def lookup_by_name(spark: SparkSession, folder: str) -> DataFrame:
    rows = (
        read(spark, folder, "orders")
        .join(read(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    )
    return change.lookup_by_name(rows, "(7|13)$", "id", "name")


@register(
    "lookup_by_id",
    "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 7",
)
def lookup_by_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders")
    return change.lookup_by_id(rows, 7, "o_custkey").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"
    )
