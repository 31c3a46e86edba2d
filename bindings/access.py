"""Slices and counts: orders as contracts, shipments as transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.labels import quarter_name
from gridloom.operators import access as op
from gridloom.operators import tables
from gridloom.sources.catalog import Catalog
from gridloom.sources.storage import new_folder

from .common import SCHEMAS, read, register, tidy


# Where the shipments of a folder have been written by quarter, by session and folder.
_BY_QUARTER: dict[tuple[str, str], str] = {}


def _quarters(spark: SparkSession, folder: str) -> Catalog:
    """Shipments as a table kept by quarter, one file to each; written once in a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BY_QUARTER:
        base = new_folder(spark)
        lines = read(spark, folder, "lineitem").withColumn("quarter", quarter_name("l_shipdate"))
        lines = lines.repartitionByRange("quarter", "l_shipdate")
        lines.write.partitionBy("quarter").parquet(f"{base}/transactions")
        _BY_QUARTER[key] = base
    return Catalog(spark, _BY_QUARTER[key], layout="quarter={quarter}")


@register(
    "quarterly_slice",
    """SELECT l_orderkey, l_shipdate, l_extendedprice, '1996q' || quarter(l_shipdate) AS quarter
    FROM lineitem WHERE l_returnflag = 'R'
      AND l_shipdate >= '1996-01-01' AND l_shipdate < '1996-07-01'""",
)
def quarterly_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Two quarters, some columns, one class."""
    return _quarters(spark, folder).quarterly(
        "transactions",
        ["1996q1", "1996q2"],
        ["l_orderkey", "l_shipdate", "l_extendedprice"],
        "l_returnflag = 'R'",
        quarter_column="quarter",
        schema=SCHEMAS["lineitem"],
    )


@register(
    "quarterly_counts",
    """SELECT year(l_shipdate) || 'q' || quarter(l_shipdate) AS quarter, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def quarterly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every quarter, named by the files."""
    table = _quarters(spark, folder).quarterly(
        "transactions", quarter_column="quarter", schema=SCHEMAS["lineitem"]
    )
    return op.value_counts(table, "quarter")


@register(
    "quarterly_one",
    """SELECT l_returnflag AS class_name, count(*) AS n FROM lineitem
    WHERE l_shipdate >= '1997-04-01' AND l_shipdate < '1997-07-01' GROUP BY ALL""",
)
def quarterly_one(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of a single quarter."""
    table = _quarters(spark, folder).quarterly(
        "transactions", ["1997q2"], schema=SCHEMAS["lineitem"]
    )
    return op.class_distribution(table.withColumnRenamed("l_returnflag", "class_name"))


SLICE_LIMIT = 50


@register(
    "slice_limit",
    f"""SELECT count(*) AS n, count(*) AS members, least(count(*), {SLICE_LIMIT}) AS shown,
      least(count(*), {SLICE_LIMIT}) AS shown_members
    FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate BETWEEN '1996-01-01' AND '1996-12-31'""",
)
def slice_limit(spark: SparkSession, folder: str) -> DataFrame:
    """A whole slice beside an unordered limit of it: how many rows come, how many belong to it."""
    lines = read(spark, folder, "lineitem")
    rows = op.date_slice(lines, "R", "1996-01-01", "1996-12-31", "l_shipdate", "l_returnflag")
    inside = (F.col("l_returnflag") == "R") & (F.year("l_shipdate") == 1996)
    tested = [
        df.select(inside.alias("inside"), F.lit(limited).alias("limited"))
        for df, limited in ((rows, False), (tables.preview(rows, SLICE_LIMIT), True))
    ]
    limited, member = F.col("limited"), F.col("inside")
    return tested[0].unionAll(tested[1]).agg(
        F.count_if(~limited).alias("n"),
        F.count_if(~limited & member).alias("members"),
        F.count_if(limited).alias("shown"),
        F.count_if(limited & member).alias("shown_members"),
    )


@register(
    "product_mix",
    """SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN '1996-01-01' AND '1997-01-01'
    GROUP BY ALL""",
)
def product_mix(spark: SparkSession, folder: str) -> DataFrame:
    return op.product_mix(
        read(spark, folder, "orders"),
        "F",
        "1996-01-01",
        "1997-01-01",
        product="o_orderpriority",
        date_col="o_orderdate",
        authority_col="o_orderstatus",
    )


@register(
    "slice_by_date",
    """SELECT * FROM lineitem WHERE l_returnflag = 'R'
      AND l_shipdate BETWEEN '1996-01-01' AND '1996-02-01'""",
)
def slice_by_date(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem")
    return op.date_slice(lines, "R", "1996-01-01", "1996-02-01", "l_shipdate", "l_returnflag")


@register(
    "slice_by_text",
    """SELECT * FROM lineitem WHERE l_returnflag = 'R'
      AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-02-01'""",
)
def slice_by_text(spark: SparkSession, folder: str) -> DataFrame:
    texts = ["l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-02-01'", "l_returnflag = 'R'"]
    return op.slice_by_text(read(spark, folder, "lineitem"), texts)


@register(
    "class_distribution",
    """SELECT nullif(l_returnflag, 'N') AS class_name, count(nullif(l_returnflag, 'N')) AS n
    FROM lineitem GROUP BY 1""",
)
def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    classes = F.nullif("l_returnflag", F.lit("N")).alias("class_name")
    return op.class_distribution(read(spark, folder, "lineitem").select(classes))


@register(
    "value_counts",
    """SELECT nullif(event_type, 'view') AS event_type, count(*) AS n FROM events
    GROUP BY 1""",
)
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.nullif("event_type", F.lit("view")).alias("event_type")
    return op.value_counts(read(spark, folder, "events").select(kinds), "event_type", True)


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(spark: SparkSession, folder: str) -> DataFrame:
    return tables.preview(read(spark, folder, "orders"), 10, ["o_orderkey"])


def _profile_sql() -> str:
    types = {
        "l_orderkey": "bigint",
        "l_partkey": "bigint",
        "l_suppkey": "bigint",
        "l_linenumber": "int",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_tax": "double",
        "returned": "string",
        "l_linestatus": "string",
        "l_shipdate": "timestamp_ntz",
    }
    return " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", '{t}' AS type,
        count({"nullif(l_returnflag, 'N')" if c == "returned" else c}) AS non_null,
        count(*) AS n_rows FROM lineitem"""
        for i, (c, t) in enumerate(types.items())
    )


@register("table_profile", _profile_sql())
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem")
    columns = [
        F.nullif(c, F.lit("N")).alias("returned") if c == "l_returnflag" else F.col(c)
        for c in lines.columns
    ]
    return tidy(tables.table_profile(lines.select(*columns)))
