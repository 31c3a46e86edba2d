from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows as tuples, sorted with nulls first."""
    picked = df.select(*[f"`{c}`" for c in columns]) if columns else df
    return sorted(map(tuple, picked.collect()), key=lambda r: [(v is not None, v) for v in r])


def by_key(df: DataFrame, key: str, value: str) -> dict:
    return {r[key]: r[value] for r in df.collect()}


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def close(a: Sequence, b: Sequence, digits: int = 9) -> bool:
    def same(x, y) -> bool:
        if isinstance(x, float) and isinstance(y, float):
            return round(x - y, digits) == 0
        return x == y

    return len(a) == len(b) and all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s))
