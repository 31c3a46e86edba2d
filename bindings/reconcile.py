"""Totals against parts, identity check, series extract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import reconcile as op

from .common import read, register, tidy

PARTS_SQL = "SELECT l_orderkey AS k, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL"


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").withColumnRenamed("o_orderkey", "order_key")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "order_key")


@register(
    "reconcile_totals",
    f"""SELECT o_orderkey AS order_key, o_totalprice AS reported, round(s, 2) AS calculated
    FROM orders JOIN ({PARTS_SQL}) ON k = o_orderkey""",
)
def reconcile_totals(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = _orders(spark, folder), _lines(spark, folder)
    return tidy(op.reconcile(orders, lines, ["order_key"], "o_totalprice", "l_extendedprice"), 2)


@register(
    "reconcile_shared",
    """WITH total AS (
      SELECT o_custkey AS party, o_orderdate AS day, sum(o_totalprice) AS reported
      FROM orders GROUP BY ALL),
    parts AS (
      SELECT l_suppkey AS party, l_shipdate AS day, sum(l_extendedprice) AS s
      FROM lineitem GROUP BY ALL)
    SELECT party, day, round(reported, 2) AS reported, round(s, 2) AS calculated
    FROM total JOIN parts USING (party, day)""",
)
def reconcile_shared(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' orders and suppliers' shipments of a day: few keys are on both sides."""
    total = (
        read(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("party"), F.col("o_orderdate").alias("day"))
        .agg(F.sum("o_totalprice").alias("o_totalprice"))
    )
    parts = read(spark, folder, "lineitem").withColumnsRenamed(
        {"l_suppkey": "party", "l_shipdate": "day"}
    )
    return tidy(op.reconcile(total, parts, ["party", "day"], "o_totalprice", "l_extendedprice"), 2)


@register(
    "shared_keys",
    """SELECT o_custkey AS party, o_orderdate AS day FROM orders
    INTERSECT SELECT l_suppkey, l_shipdate FROM lineitem""",
)
def shared_keys(spark: SparkSession, folder: str) -> DataFrame:
    left = read(spark, folder, "orders").select(
        F.col("o_custkey").alias("party"), F.col("o_orderdate").alias("day")
    )
    right = read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("party"), F.col("l_shipdate").alias("day")
    )
    return op.shared_keys(left, right, ["party", "day"])


@register(
    "reconcile_grid",
    """WITH total AS (
      SELECT c_nationkey AS nation, o_orderdate AS day, sum(o_totalprice) AS reported
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    parts AS (
      SELECT s_nationkey AS nation, l_shipdate AS day, sum(l_extendedprice) AS s
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    grid AS (
      SELECT n.nation, d.day FROM (SELECT DISTINCT nation FROM parts) n,
        (SELECT DISTINCT day FROM parts) d)
    SELECT nation, day, round(reported, 2) AS reported, round(coalesce(s, 0), 2) AS calculated
    FROM total JOIN grid USING (nation, day) LEFT JOIN parts USING (nation, day)""",
)
def reconcile_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Sales by customer nation and day beside shipments by supplier nation and day."""
    total = (
        read(spark, folder, "orders")
        .join(read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderdate").alias("day"))
        .agg(F.sum("o_totalprice").alias("o_totalprice"))
    )
    parts = (
        read(spark, folder, "lineitem")
        .join(read(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("s_nationkey").alias("nation"),
            F.col("l_shipdate").alias("day"),
            "l_extendedprice",
        )
    )
    result = op.reconcile(
        total, parts, ["nation", "day"], "o_totalprice", "l_extendedprice", complete_grid=True
    )
    return tidy(result, 2)


@register(
    "identity_check",
    """SELECT l_returnflag AS label, l_extendedprice AS reported,
      round(l_extendedprice * (1 + l_tax) - l_extendedprice * l_tax, 4) AS calculated
    FROM lineitem""",
)
def identity_check(spark: SparkSession, folder: str) -> DataFrame:
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    lines = read(spark, folder, "lineitem")
    result = op.identity_check(lines, price, price * (1 + tax), price * tax, "l_returnflag")
    return tidy(result, 4)


@register(
    "series_extract",
    """WITH picked AS (
      SELECT ts, value, value * 2 AS doubled FROM events
      WHERE event_type = 'purchase' AND ts BETWEEN '2024-01-05' AND '2024-01-20')
    SELECT ts, 'value' AS series, value FROM picked
    UNION ALL SELECT ts, 'doubled', doubled FROM picked""",
)
def series_extract(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").withColumn("doubled", F.col("value") * 2)
    return op.series_extract(
        events,
        "purchase",
        "2024-01-05",
        "2024-01-20",
        measures=["value", "doubled"],
        entity_col="event_type",
        time_col="ts",
        long=True,
    )
