"""Plans whose uses share one evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import named


def kept_whole(df: DataFrame, keys: Sequence[str], plain: Sequence[str] = ()) -> DataFrame:
    """The same rows, in a form whose every use reads the same shuffle.

    A plan that is used twice is evaluated twice if one use needs fewer columns or filters
    rows: the optimizer prunes each on its own, and Spark reuses a shuffle only for another
    that is equal. Here the rows of a key go through one shuffle as a list, which is neither
    pruned nor filtered below, so that shuffle serves all uses and nothing is stored.

    The rows of a key must be few by their nature (one, or one per year), as they meet in one
    list. Columns named in ``plain`` are among the keys and stay open: tests on them still
    reach the scan. Rows whose keys are null are kept.
    """
    rest = [c for c in df.columns if c not in plain]
    rows = F.collect_list(F.struct(*map(named, rest))).alias("__rows")
    listed = df.groupBy(*map(named, keys)).agg(rows).repartition(*map(named, keys))
    return listed.select(*map(named, plain), F.inline("__rows")).select(*map(named, df.columns))
