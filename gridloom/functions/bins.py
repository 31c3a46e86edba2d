"""Equal-width bins over a fixed range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column


def bin_index(value: Column | str, bins: int, low: float, high: float) -> Column:
    """Bin number of a value, null outside ``[low, high]``.

    Bin ``i`` holds ``edge(i) <= value < edge(i + 1)`` with ``edge(i) = i * width + low``;
    the last bin also holds ``high``. The quotient alone can land one bin away from that
    (``0.29 * 100`` is below 29), so it is compared with the edges and moved.
    """
    column = as_column(value).cast("double")
    step = (high - low) / bins

    def edge(index: Column) -> Column:
        return index * F.lit(step) + F.lit(float(low))

    guess = F.least(
        F.floor((column - F.lit(float(low))) * F.lit(bins / (high - low))),
        F.lit(bins - 1).cast("long"),
    )
    moved = (
        F.when(column < edge(guess), guess - 1)
        .when((guess < bins - 1) & (column >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    return F.when((column >= low) & (column <= high), moved).cast("int")
