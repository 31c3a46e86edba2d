"""Tables to CSV: wide ones by measure, long ones by quarter within a row budget."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import named
from ..functions.labels import quarter_name
from ..operators.profiles import (
    MEASURES,
    TIME_COLUMNS,
    wide,
    wide_measure,
)
from ..sources.csv import SPREADSHEET_ROWS, write_csv
from ..sources.storage import stored


def export_wide(
    df: DataFrame,
    folder: str,
    headers: Sequence[str],
    measures: Sequence[str] = MEASURES,
    time_cols: Sequence[str] = TIME_COLUMNS,
    place_col: str = "place_name",
    state_col: str = "state",
) -> dict[str, DataFrame]:
    """Reshapes all measures in one pass, writes ``{folder}/{measure}``, returns the tables."""
    measures = list(measures)
    if len(measures) == 1:
        (only,) = measures
        table = wide(df, headers, measures, time_cols, place_col, state_col)
        tables = {only: table.orderBy(*time_cols)}
    else:
        # Every measure is one write; the pass over the input they share is stored beside them.
        combined = stored(wide(df, headers, measures, time_cols, place_col, state_col), folder)
        tables = {m: wide_measure(combined, m, measures, time_cols) for m in measures}
    for measure, table in tables.items():
        write_csv(table, f"{folder}/{measure}")
    return tables


@dataclass(frozen=True)
class Exported:
    """What an export wrote: its folder, its rows, and the rows a file may hold."""

    folder: str
    rows: int
    budget: int

    @property
    def fits(self) -> bool:
        """Whether one spreadsheet could have held all rows."""
        return self.rows <= self.budget


def export_quarters(
    df: DataFrame,
    folder: str,
    time_col: str,
    quarter_col: str = "quarter",
    rows_per_file: int = SPREADSHEET_ROWS,
) -> Exported:
    """Writes ``{folder}/{quarter_col}=1996q1/*.csv``, no file above the row budget.

    Rows are dealt out by ranges of time, so a quarter lies in few tasks and a large one in
    several, each of which cuts its files at the budget. Rows are counted while they are
    written. Rows without a time go to the quarter named ``none``.
    """
    counted = Observation()
    quarter = F.coalesce(quarter_name(time_col), F.lit("none"))
    rows = df.withColumn(quarter_col, quarter).repartitionByRange(quarter_col, named(time_col))
    rows = rows.observe(counted, F.count(F.lit(1)).alias("rows"))
    write_csv(rows, folder, [quarter_col], rows_per_file)
    return Exported(folder, counted.get["rows"], rows_per_file)
