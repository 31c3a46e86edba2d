"""Checks on keys that run inside the query they guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_column, named


def unique_rows(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """The rows of ``df``; a query that reads them fails if a key, null ones included, repeats.

    The rows are counted where a join on the same keys brings them anyway, so the check costs
    neither a job nor a shuffle of its own.
    """
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*map(named, keys)).agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(named(c)).alias(c) for c in rest]
    )
    single = F.when(F.col("__n") > 1, F.raise_error(F.lit(message)).cast("boolean"))
    return counted.where(single.otherwise(F.lit(True))).select(*map(named, df.columns))


def only_value(value: Column | str, message: str) -> Column:
    """Aggregate that returns the value of a one-row group and fails on a larger group.

    It costs no job of its own; it fires when the result column is read.
    """
    single = F.first(as_column(value))
    return F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(message))).otherwise(single)
