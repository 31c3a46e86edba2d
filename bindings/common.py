"""Registry of queries and the frames derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


# The driver's tables, so that opening one starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double,"
    " props string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return Catalog(spark, folder).table(table, schema=SCHEMAS[table])


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds floating columns, whose last digits depend on the order of summation."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in floats})


# Reported demand by respondent: lineitem through orders -----------------------------------

DEMAND_SQL = """
hourly AS (
  SELECT l_suppkey AS rid, l_shipdate AS t, o_orderdate AS rd, l_extendedprice AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
realized AS (
  SELECT rid, CAST(year(rd) AS INTEGER) AS yr, max(d) AS peak, sum(d) AS total
  FROM hourly WHERE year(t) = year(rd) GROUP BY ALL),
forecast AS (
  SELECT rid, yr AS report_year, CAST(yr + k AS INTEGER) AS forecast_year,
    CASE WHEN (rid + k) % 11 = 0 THEN 0e0
         ELSE peak * (1 + 2e-2 * ((rid + yr + k) % 7 - 3)) END AS summer,
    CASE WHEN (rid + yr) % 13 = 0 THEN NULL WHEN (rid + k) % 11 = 0 THEN 0e0
         ELSE peak * (1 + 1e-2 * ((rid + k) % 5 - 2)) END AS winter
  FROM realized, range(0, 13) AS g(k) WHERE yr BETWEEN 1995 AND 2000)"""


def hourly_demand(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem")
    orders = read(spark, folder, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("respondent_id_ferc714"),
        F.col("l_shipdate").alias("datetime_utc"),
        F.col("o_orderdate").alias("report_date"),
        F.col("l_extendedprice").alias("demand_mwh"),
    )


def forecasts_from(realized: DataFrame) -> DataFrame:
    """Thirteen forecasts of each respondent and year 1995 to 2000, spread around its peak."""
    rid, year, k = F.col("respondent_id_ferc714"), F.col("year"), F.col("k")
    peak = F.col("realized_peak")
    zero = (rid + k) % 11 == 0
    summer = peak * (1 + 0.02 * ((rid + year + k) % 7 - 3))
    winter = peak * (1 + 0.01 * ((rid + k) % 5 - 2))
    return (
        realized.where(year.between(1995, 2000))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("k"))
        .select(
            rid,
            year.alias("report_year"),
            (year + k).alias("forecast_year"),
            F.when(zero, 0.0).otherwise(summer).alias("summer_peak_demand_forecast_mw"),
            F.when((rid + year) % 13 == 0, None)
            .when(zero, 0.0)
            .otherwise(winter)
            .alias("winter_peak_demand_forecast_mw"),
        )
    )


def respondents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("respondent_id_ferc714"),
        F.col("s_name").alias("respondent_name_ferc714"),
        F.lit("2000-01-01").cast("date").alias("report_date"),
    )


# Plants, generators and months: suppliers, parts and shipments ----------------------------

EXPLORER_SQL = """
places AS (
  SELECT s_suppkey AS plant_id_eia, s_name AS plant_name_eia, r_name AS state,
    n_name AS county, s_acctbal AS latitude,
    CASE WHEN s_acctbal < 3000 THEN NULL WHEN s_acctbal < 6000 THEN '' ELSE s_name END AS city
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
plants AS (
  SELECT DISTINCT places.*, make_date(year(l_shipdate), 1, 1) AS report_date
  FROM lineitem JOIN places ON l_suppkey = plant_id_eia),
generators AS (
  SELECT DISTINCT l_suppkey AS plant_id_eia, make_date(year(l_shipdate), 1, 1) AS report_date,
    CAST(l_partkey AS VARCHAR) AS generator_id, p_type AS technology_description,
    p_brand AS prime_mover_code, split_part(p_name, ' ', 1) AS fuel_type_code,
    CASE WHEN p_size <= 25 THEN 'existing' WHEN p_size <= 40 THEN 'retired' END
      AS operational_status,
    p_size / 2e0 AS capacity_mw
  FROM lineitem JOIN part ON l_partkey = p_partkey),
monthly AS (
  SELECT l_suppkey AS plant_id_eia,
    make_date(year(l_shipdate), month(l_shipdate), 1) AS report_date,
    CAST(l_partkey AS VARCHAR) AS generator_id, l_linestatus AS prime_mover_code,
    nullif(l_returnflag, 'N') AS fuel_type_code, l_quantity AS net_generation_mwh
  FROM lineitem)"""


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Plants without the years of their records."""
    balance = F.col("s_acctbal")
    city = F.when(balance < 3000, None).when(balance < 6000, "").otherwise(F.col("s_name"))
    return (
        read(spark, folder, "supplier")
        .join(read(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("plant_id_eia"),
            F.col("s_name").alias("plant_name_eia"),
            F.col("r_name").alias("state"),
            F.col("n_name").alias("county"),
            balance.alias("latitude"),
            city.alias("city"),
        )
    )


def plants(spark: SparkSession, folder: str) -> DataFrame:
    known = places(spark, folder)
    years = read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("plant_id_eia"),
        F.trunc("l_shipdate", "year").alias("report_date"),
    )
    return years.distinct().join(known, "plant_id_eia").select(*known.columns, "report_date")


def generators(spark: SparkSession, folder: str) -> DataFrame:
    """Generator rows as the table holds them, repeats included."""
    size = F.col("p_size")
    parts = read(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_type").alias("technology_description"),
        F.col("p_brand").alias("prime_mover_code"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("fuel_type_code"),
        F.when(size <= 25, "existing").when(size <= 40, "retired").alias("operational_status"),
        (size / 2).alias("capacity_mw"),
        F.lit("final").alias("data_maturity"),
    )
    lines = read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("plant_id_eia"),
        F.trunc("l_shipdate", "year").alias("report_date"),
        "l_partkey",
    )
    return (
        lines.join(parts, "l_partkey")
        .withColumn("generator_id", F.col("l_partkey").cast("string"))
        .drop("l_partkey")
    )


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("plant_id_eia"),
        F.trunc("l_shipdate", "month").alias("report_date"),
        F.col("l_partkey").cast("string").alias("generator_id"),
        F.col("l_linestatus").alias("prime_mover_code"),
        F.nullif("l_returnflag", F.lit("N")).alias("fuel_type_code"),
        F.col("l_quantity").alias("net_generation_mwh"),
    )
