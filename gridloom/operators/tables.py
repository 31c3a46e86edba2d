"""What a table holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named


def table_profile(df: DataFrame) -> DataFrame:
    """Position, name, type and count of known values of each column, in one scan."""
    counts = [F.count(named(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    described = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col(f"c{i}").alias("non_null"),
            F.col("n_rows"),
        )
        for i, field in enumerate(df.schema.fields)
    ]
    return totals.select(F.inline(F.array(*described)))


def preview(df: DataFrame, n: int = 10, order: Sequence[str] = ()) -> DataFrame:
    """The first rows, in a stable order if one is given."""
    return (df.orderBy(*[named(c) for c in order]) if order else df).limit(n)
