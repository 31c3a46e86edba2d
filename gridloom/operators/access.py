"""Slices and counts of large quarterly tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named

DELIVERY_AUTHORITY = "point_of_delivery_balancing_authority"


def value_counts(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    rows = df if keep_null else df.where(named(column).isNotNull())
    counts = rows.groupBy(named(column)).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), named(column).asc_nulls_last())


def class_distribution(df: DataFrame, column: str = "class_name") -> DataFrame:
    """Known values per class over the whole table; the null class shows 0."""
    return df.groupBy(named(column)).agg(F.count(named(column)).alias("n"))


def date_slice(
    df: DataFrame,
    authority: str | None,
    start: date | str,
    end: date | str,
    date_col: str,
    authority_col: str = DELIVERY_AUTHORITY,
    whole_days: bool = False,
) -> DataFrame:
    """Rows of one authority between two days.

    Both days are included for a column of dates. A column of timestamps is compared with
    midnight, so of the last day only that moment counts, unless ``whole_days`` is set.
    """
    first, last = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    inside = named(date_col).between(first, last)
    if whole_days:
        inside = (named(date_col) >= first) & (named(date_col) < F.date_add(last, 1))
    rows = df.where(inside)
    return rows if authority is None else rows.where(named(authority_col) == authority)


def product_mix(
    contracts: DataFrame,
    authority: str,
    start: date | str,
    end: date | str,
    product: str = "product_type_name",
    date_col: str = "contract_execution_date",
    authority_col: str = DELIVERY_AUTHORITY,
) -> DataFrame:
    """Contracts per product type of one authority in a range of days."""
    rows = date_slice(contracts, authority, start, end, date_col, authority_col)
    return value_counts(rows, product)


def slice_by_text(df: DataFrame, predicates: Sequence[str | Column]) -> DataFrame:
    """Rows that pass every predicate, each given as SQL text or as a column."""
    return reduce(DataFrame.where, predicates, df)
