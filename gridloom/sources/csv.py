"""CSV in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Fixed value: rows a spreadsheet can open.
SPREADSHEET_ROWS = 1_000_000


def exceeds_budget(df: DataFrame, rows: int = SPREADSHEET_ROWS) -> bool:
    """Whether the table has more rows than one spreadsheet holds."""
    return df.count() > rows


def write_csv(
    df: DataFrame,
    folder: str,
    split_by: Sequence[str] = (),
    rows_per_file: int = SPREADSHEET_ROWS,
    mode: str = "errorifexists",
) -> None:
    """Header line, empty text for null, no file above the row budget.

    ``split_by`` gives one subfolder per value, such as one per quarter.
    """
    writer = (
        df.write.mode(mode)
        .option("header", True)
        .option("nullValue", "")
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("maxRecordsPerFile", rows_per_file)
    )
    if split_by:
        writer = writer.partitionBy(*split_by)
    writer.csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """Reads such files back with declared types; empty text is null."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "")
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .csv(folder)
    )
