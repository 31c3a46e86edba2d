"""Null rules and scalar rules that differ from Spark's own defaults."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(value: Column | str) -> Column:
    return named(value) if isinstance(value, str) else value


def sum0(value: Column | str) -> Column:
    """Sum in which a group of nulls counts 0."""
    return F.coalesce(F.sum(as_column(value)), F.lit(0))


def max_strict(left: Column | str, right: Column | str) -> Column:
    """The larger of two values, null if either one is null."""
    a, b = as_column(left), as_column(right)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def relative_error(estimate: Column | str, actual: Column | str) -> Column:
    """``(estimate - actual) / actual``; 0 where either is zero or null."""
    e, a = as_column(estimate), as_column(actual)
    return F.coalesce(F.when((e != 0) & (a != 0), F.try_divide(e - a, a)), F.lit(0.0))


def percent_change(first: Column | str, value: Column | str) -> Column:
    """Change from ``first`` to ``value`` in percent; null where ``first`` is 0."""
    a, b = as_column(first), as_column(value)
    return F.try_divide(b - a, a) * 100


def isin_nullsafe(value: Column | str, options: Iterable[Any]) -> Column:
    """Membership test in which a chosen null matches null rows."""
    column, chosen = as_column(value), list(options)
    given = [o for o in chosen if o is not None]
    test = F.coalesce(column.isin(given), F.lit(False)) if given else F.lit(False)
    return test | column.isNull() if len(given) < len(chosen) else test


def all_of(predicates: Iterable[Column]) -> Column:
    """AND of any number of predicates; no predicate keeps every row."""
    return reduce(and_, predicates, F.lit(True))


def null_or(predicate: Column, value: Column | str) -> Column:
    """The predicate, with null values let through."""
    return as_column(value).isNull() | predicate


def has_prefix(value: Column | str, prefixes: Sequence[str]) -> Column:
    column = as_column(value)
    return reduce(or_, [column.startswith(p) for p in prefixes], F.lit(False))


def strip_ws(value: Column | str) -> Column:
    """Removes every kind of white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(as_column(value), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def year_range(date: Column | str, first_year: int | None, last_year: int | None) -> Column:
    """Inclusive range of years as plain bounds on the date, so that it reaches the scan."""
    column, tests = as_column(date), []
    if first_year is not None:
        tests.append(column >= F.lit(f"{first_year:04d}-01-01").cast("date"))
    if last_year is not None:
        tests.append(column < F.lit(f"{last_year + 1:04d}-01-01").cast("date"))
    return all_of(tests)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def lower_strings(df: DataFrame) -> DataFrame:
    """Every string column in lower case."""
    return df.withColumns({c: F.lower(named(c)) for c in string_columns(df)})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN, as some writers store missing values, to null."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.when(~F.isnan(named(c)), named(c)) for c in floats})


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Removes a prefix from the column names that start with it."""
    own = [c for c in df.columns if c.startswith(prefix)]
    return df.withColumnsRenamed({c: c.removeprefix(prefix) for c in own})
