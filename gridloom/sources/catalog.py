"""Tables by name under a versioned base path."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named

QUARTER_IN_PATH = r"(\d{4}q[1-4])[^/]*(?:/[^/]*)?$"


@dataclass(frozen=True)
class Catalog:
    """Reads ``{base}/{version}/{table}.parquet`` and ``{base}/{version}/{table}/{quarter}.parquet``.

    A table or a quarter is one file or a directory of part files. ``layout`` names the entry
    of a quarter; ``quarter={quarter}`` reads tables that Spark partitioned by quarter.
    Geometry columns arrive as binary and pass through untouched.
    """

    spark: SparkSession
    base: str
    version: str | None = None
    layout: str = "{quarter}.parquet"

    def path(self, name: str) -> str:
        parts = [self.base.rstrip("/"), self.version, name]
        return "/".join(p for p in parts if p)

    def table(
        self,
        name: str,
        columns: Sequence[str] | None = None,
        where: Column | str | None = None,
        schema: T.StructType | str | None = None,
    ) -> DataFrame:
        """One table; ``where`` and ``columns`` reach the scan, a ``schema`` saves reading it."""
        return _narrow(self._reader(schema).parquet(self.path(f"{name}.parquet")), columns, where)

    def quarterly(
        self,
        name: str,
        quarters: Sequence[str] | None = None,
        columns: Sequence[str] | None = None,
        where: Column | str | None = None,
        quarter_column: str | None = None,
        schema: T.StructType | str | None = None,
    ) -> DataFrame:
        """Table kept by quarter; only the named quarters, or all, are listed and read."""
        wanted = ["*"] if quarters is None else quarters
        entries = [self.path(f"{name}/{self.layout.format(quarter=q)}") for q in wanted]
        df = self._reader(schema).parquet(*entries)
        if quarter_column is not None:
            df = with_quarter(df, quarter_column)
            if columns is not None:
                columns = [*columns, quarter_column]
        return _narrow(df, columns, where)

    def matching(self, pattern: str) -> DataFrame:
        """All files below the base path that match a glob."""
        return self.spark.read.parquet(self.path(pattern))

    def _reader(self, schema: T.StructType | str | None):
        return self.spark.read if schema is None else self.spark.read.schema(schema)


def with_quarter(df: DataFrame, column: str = "quarter") -> DataFrame:
    """Adds the quarter taken from the name of the file or of the directory that holds it.

    A file whose path names no quarter fails the query.
    """
    path = F.col("_metadata.file_path")
    found = F.regexp_extract(path, QUARTER_IN_PATH, 1)
    missing = F.raise_error(F.concat(F.lit("no quarter in the path "), path))
    return df.withColumn(column, F.when(found != "", found).otherwise(missing.cast("string")))


def _narrow(
    df: DataFrame, columns: Sequence[str] | None, where: Column | str | None
) -> DataFrame:
    if where is not None:
        df = df.where(where)
    return df if columns is None else df.select(*[named(c) for c in columns])
