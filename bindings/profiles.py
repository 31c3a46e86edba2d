"""Profiles by place: nations as places, orders and shipments as hourly rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.labels import fixed
from gridloom.operators import profiles as op
from gridloom.plans.export import export_quarters, export_wide
from gridloom.sources.csv import read_csv
from gridloom.sources.storage import new_folder

from .common import read, register, tidy

PROFILE_SQL = """
profile AS (
  SELECT c_nationkey AS nation, o_orderdate AS datetime_utc, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "orders")
        .join(read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_nationkey").alias("nation"),
            F.col("o_orderdate").alias("datetime_utc"),
            F.col("o_totalprice").alias("price"),
        )
    )


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")


def _profile_with_state(spark: SparkSession, folder: str) -> DataFrame:
    states = (
        read(spark, folder, "nation")
        .join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("state"))
    )
    return _profile(spark, folder).join(states, "nation")


@register(
    "geo_join",
    f"""WITH {PROFILE_SQL}
    SELECT CAST(nation AS VARCHAR) AS nation, n_name, datetime_utc, price, r_name AS state
    FROM profile JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def geo_join(spark: SparkSession, folder: str) -> DataFrame:
    profile = _profile_with_state(spark, folder)
    return op.geo_join(_places(spark, folder), profile, key="nation")


@register(
    "snapshot",
    f"""WITH {PROFILE_SQL}
    SELECT CAST(nation AS VARCHAR) AS nation, n_name, datetime_utc, price, r_name AS state
    FROM profile JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND datetime_utc = TIMESTAMP '1997-05-28 00:00:00'""",
)
def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    profile = _profile_with_state(spark, folder)
    joined = op.geo_join(_places(spark, folder), profile, state="ASIA", key="nation")
    return op.snapshot(joined, "1997-05-28 00:00:00")


@register(
    "exclude_prefixes",
    """WITH ids AS (
      SELECT CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 5, '0')
        ELSE CAST(o_orderkey AS VARCHAR) END AS county_id_fips, o_totalprice FROM orders)
    SELECT * FROM ids
    WHERE left(county_id_fips, 2) NOT IN ('02', '15', '60', '66', '69', '72', '78')""",
)
def exclude_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    # Padding to five digits would cut longer ids.
    text = F.col("o_orderkey").cast("string")
    ids = F.when(F.col("o_orderkey") < 10_000, F.lpad(text, 5, "0")).otherwise(text)
    ids = ids.alias("county_id_fips")
    return op.exclude_prefixes(read(spark, folder, "orders").select(ids, "o_totalprice"))


@register(
    "frames",
    f"""WITH {PROFILE_SQL},
    shown AS (
      SELECT CAST(nation AS VARCHAR) AS nation, datetime_utc, price, n_name
      FROM profile JOIN nation ON nation = n_nationkey
      WHERE datetime_utc BETWEEN '1996-01-01' AND '1997-12-31'),
    numbers AS (
      SELECT datetime_utc, row_number() OVER (ORDER BY datetime_utc) - 1 AS frame
      FROM (SELECT DISTINCT datetime_utc FROM shown))
    SELECT *, 'Price ' || strftime(datetime_utc, '%Y-%m-%d %H:%M:%S') || ' UTC' AS frame_title
    FROM shown JOIN numbers USING (datetime_utc)""",
)
def frames(spark: SparkSession, folder: str) -> DataFrame:
    return op.frames(
        _profile(spark, folder),
        _places(spark, folder),
        "price",
        "1996-01-01",
        "1997-12-31",
        key="nation",
    )


KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
HEADERS = [f"{k}__{f.lower()}" for k in KINDS for f in "ANR"]
SHIPPED = {
    "quantity": "sum({} l_quantity END)",
    "lines": "count({} 1 END)",
    "largest": "max({} l_quantity END)",
}


def _wide_sql(value: str = SHIPPED["quantity"], extra: str = "") -> str:
    cells = []
    for k in KINDS:
        for f in "ANR":
            case = value.format(f"CASE WHEN p_type = '{k}' AND l_returnflag = '{f}' THEN")
            # A combination without shipments is missing, not 0.
            cells.append(f'CAST(nullif({case}, 0) AS DOUBLE) AS "{k}__{f.lower()}"')
    return f"""SELECT {extra}CAST(year(l_shipdate) AS INTEGER) AS ship_year,
      CAST(month(l_shipdate) AS INTEGER) AS ship_month, {", ".join(cells)}
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


def _tall(spark: SparkSession, folder: str) -> DataFrame:
    """Shipped quantity per month, part type and return flag."""
    return (
        read(spark, folder, "lineitem")
        .join(read(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.year("l_shipdate").alias("ship_year"),
            F.month("l_shipdate").alias("ship_month"),
            "p_type",
            "l_returnflag",
        )
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.count(F.lit(1)).cast("double").alias("lines"),
            F.max("l_quantity").alias("largest"),
        )
    )


@register("wide_reshape", _wide_sql())
def wide_reshape(spark: SparkSession, folder: str) -> DataFrame:
    return op.wide(
        _tall(spark, folder),
        HEADERS,
        ["quantity"],
        ["ship_year", "ship_month"],
        "p_type",
        "l_returnflag",
    )


@register(
    "csv_export",
    " UNION ALL ".join(_wide_sql(v, f"'{m}' AS measure, ") for m, v in SHIPPED.items()),
)
def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    """Three wide tables written to CSV and read back with declared types."""
    target = new_folder(spark)
    tables = export_wide(
        _tall(spark, folder),
        target,
        HEADERS,
        list(SHIPPED),
        ["ship_year", "ship_month"],
        "p_type",
        "l_returnflag",
    )
    read_back = [
        read_csv(spark, f"{target}/{m}", t.schema).withColumn("measure", F.lit(m))
        for m, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, read_back)


ROWS_PER_FILE = 1_000


@register(
    "csv_by_quarter",
    f"""WITH q AS (
      SELECT year(l_shipdate) || 'q' || quarter(l_shipdate) AS quarter, count(*) AS n,
        sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)
    SELECT quarter, n, quantity, n > {ROWS_PER_FILE} AS in_several_files, true AS within_budget,
      CAST((SELECT sum(n) FROM q) AS BIGINT) AS exported FROM q""",
)
def csv_by_quarter(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments written to CSV by quarter under a row budget, and what each quarter's files hold."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    written = export_quarters(lines, new_folder(spark), "l_shipdate", rows_per_file=ROWS_PER_FILE)
    files = (
        read_csv(spark, written.folder, lines.schema)
        .groupBy("quarter", F.col("_metadata.file_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    )
    return files.groupBy("quarter").agg(
        F.sum("n").alias("n"),
        F.sum("quantity").alias("quantity"),
        (F.count(F.lit(1)) > 1).alias("in_several_files"),
        (F.max("n") <= written.budget).alias("within_budget"),
        F.lit(written.rows).cast("long").alias("exported"),
    )


@register(
    "histogram_fixed",
    """WITH v AS (
      SELECT l_returnflag, l_discount + l_tax AS x, count(*) AS c FROM lineitem GROUP BY ALL),
    spine AS (
      SELECT l_returnflag, CAST(b AS INTEGER) AS bin, max(x) AS max_value
      FROM v, range(0, 100) AS g(b) GROUP BY ALL),
    binned AS (
      SELECT s.l_returnflag, s.bin, sum(c) AS n FROM spine s JOIN v
        ON v.l_returnflag = s.l_returnflag AND x >= bin * 1e-2
        AND (x < (bin + 1) * 1e-2 OR (bin = 99 AND x <= 1)) GROUP BY ALL)
    SELECT l_returnflag, bin, round(bin * 1e-2, 6) AS bin_start,
      CAST(coalesce(n, 0) AS BIGINT) AS n, round(max_value, 6) AS max_value,
      'county: ' || l_returnflag || '; state: all; gen: charge; max:'
        || printf('%.2f', max_value) AS title
    FROM spine LEFT JOIN binned USING (l_returnflag, bin)""",
)
def histogram_fixed(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").select(
        "l_returnflag", (F.col("l_discount") + F.col("l_tax")).alias("charge")
    )
    bins = op.histogram(lines, "charge", by=["l_returnflag"])
    title = op.histogram_title("l_returnflag", F.lit("all"), "charge", "max_value")
    return tidy(bins.withColumn("title", title))


@register(
    "histogram_total",
    """WITH v AS (SELECT l_tax AS x, count(*) AS c FROM lineitem GROUP BY ALL)
    SELECT CAST(b AS INTEGER) AS bin, round(b * 1e-2, 6) AS bin_start,
      CAST(coalesce(sum(c), 0) AS BIGINT) AS n, (SELECT max(x) FROM v) AS max_value
    FROM range(0, 100) AS g(b) LEFT JOIN v
      ON x >= b * 1e-2 AND (x < (b + 1) * 1e-2 OR (b = 99 AND x <= 1)) GROUP BY b""",
)
def histogram_total(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(op.histogram(read(spark, folder, "lineitem"), "l_tax"))


COUNTY_SQL = """WITH v AS (
      SELECT l_suppkey AS k, s_name, s_nationkey, l_tax + l_discount AS x
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    tops AS (SELECT k, s_name, s_nationkey, max(x) AS m FROM v GROUP BY ALL),
    edges AS (SELECT CAST(b AS INTEGER) AS bin FROM range(0, 100) AS g(b)),
    spots AS (SELECT DISTINCT x FROM v),
    bins AS (
      SELECT x, bin FROM spots JOIN edges
        ON x >= bin * 1e-2 AND (x < (bin + 1) * 1e-2 OR (bin = 99 AND x <= 1))),
    counts AS (SELECT k, bin, count(*) AS n FROM v JOIN bins USING (x) GROUP BY ALL)
    SELECT k AS county_id_fips, bin, round(bin * 1e-2, 6) AS bin_start, coalesce(n, 0) AS n,
      round(m, 6) AS max_value, 'county: ' || s_name || '; state: ' || s_nationkey
        || '; gen: charge; max:' || printf('%.2f', m) AS title
    FROM tops CROSS JOIN edges LEFT JOIN counts USING (k, bin)"""


@register("county_histograms", COUNTY_SQL)
def county_histograms(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(op.county_histograms(_counties(spark, folder), "charge"))


ONE_COUNTY = 7


@register(
    "county_histogram_one",
    f"{COUNTY_SQL} WHERE k = {ONE_COUNTY}",
)
def county_histogram_one(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(op.county_histograms(_counties(spark, folder), "charge", fips=ONE_COUNTY))


def _counties(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as counties."""
    return (
        read(spark, folder, "lineitem")
        .join(read(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_suppkey").alias("county_id_fips"),
            F.col("s_name").alias("place_name"),
            F.col("s_nationkey").cast("string").alias("state"),
            F.col("l_shipdate").alias("datetime_utc"),
            (F.col("l_tax") + F.col("l_discount")).alias("capacity_factor_charge"),
        )
    )


STATISTICS_SQL = """
base AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, r_name, n_name, s_suppkey,
    l_discount, l_tax, l_quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
long AS (
  SELECT ship_year, r_name, n_name, s_suppkey, 'discount' AS gen_type, l_discount AS x FROM base
  UNION ALL SELECT ship_year, r_name, n_name, s_suppkey, 'tax', l_tax FROM base
  UNION ALL SELECT ship_year, r_name, n_name, s_suppkey, 'quantity', l_quantity FROM base),
stats AS (
  SELECT ship_year, r_name, n_name, s_suppkey, gen_type, avg(x) AS average_capacity_factor,
    var_samp(x) AS average_variance
  FROM long GROUP BY ALL)"""


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    lines = (
        read(spark, folder, "lineitem")
        .join(read(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("ship_year", F.year("l_shipdate"))
    )
    return op.mean_var_long(
        lines,
        ["discount", "tax", "quantity"],
        ["ship_year", "r_name", "n_name", "s_suppkey"],
        prefix="l_",
    )


@register(
    "mean_var_long",
    f"""WITH {STATISTICS_SQL}
    SELECT ship_year, r_name, n_name, s_suppkey, gen_type,
      round(average_capacity_factor, 9) AS average_capacity_factor,
      round(average_variance, 9) AS average_variance FROM stats""",
)
def mean_var_long(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(_statistics(spark, folder), 9)


@register(
    "scatter_points",
    f"""WITH {STATISTICS_SQL}
    SELECT ship_year, r_name, n_name, s_suppkey, gen_type,
      printf('%.2f', average_capacity_factor) AS average_text,
      round(average_variance, 9) AS average_variance,
      coalesce(average_variance BETWEEN 5e-4 AND 200, false) AS in_range
    FROM stats WHERE gen_type IN ('discount', 'quantity')""",
)
def scatter_points(spark: SparkSession, folder: str) -> DataFrame:
    points = op.scatter_points(_statistics(spark, folder), (5e-4, 200), ["discount", "quantity"])
    text = fixed("average_capacity_factor", 2).alias("average_text")
    columns = ["ship_year", "r_name", "n_name", "s_suppkey", "gen_type"]
    return tidy(points.select(*columns, text, "average_variance", "in_range"), 9)


@register(
    "brushed_average",
    f"""WITH {STATISTICS_SQL}
    SELECT gen_type, round(avg(average_capacity_factor), 6) AS average_capacity_factor,
      gen_type IN ('tax') AS chosen
    FROM stats WHERE average_capacity_factor > 0 AND average_variance BETWEEN 5e-4 AND 200
    GROUP BY ALL""",
)
def brushed_average(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(op.brushed_average(_statistics(spark, folder), (5e-4, 200), ["tax"]))
