"""Texts shown beside the figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column


def fixed(value: Column | str, digits: int) -> Column:
    """Number as text with a fixed count of decimals.

    Rounds the exact binary value, ties to the even digit; ``format_string`` and ``bround``
    round its shortest decimal text instead and differ on values such as 22.075.
    """
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", as_column(value).cast("double"), F.lit(pattern))


def percent(value: Column | str, digits: int) -> Column:
    return F.concat(fixed(value, digits), F.lit("%"))


def title_words(name: str) -> str:
    """``capacity_factor_solar_pv`` to ``Capacity Factor Solar Pv``."""
    return name.replace("_", " ").title()


def title_case(value: Column | str) -> Column:
    """The same rule for a column of names."""
    return F.initcap(F.replace(as_column(value), F.lit("_"), F.lit(" ")))


def place_header(place: Column | str, state: Column | str) -> Column:
    """``place__state``, null if either part is null."""
    return F.concat(as_column(place), F.lit("__"), F.lower(as_column(state)))


def option_text(value: Column | str) -> Column:
    """Text of one option; a missing value reads ``None``."""
    return F.coalesce(as_column(value).cast("string"), F.lit("None"))


def name_with_id(name: Column | str, identity: Column | str) -> Column:
    return F.concat(option_text(name), F.lit(" (id="), option_text(identity), F.lit(")"))


def text_or(first: Column | str, second: Column | str) -> Column:
    """First text, or the second where the first is null or empty."""
    return F.coalesce(F.nullif(as_column(first), F.lit("")), as_column(second))


def counted_values(entries: Column) -> Column:
    """Array of ``struct(value, n)`` to ``value (n), value (n)``, largest count first."""
    ranked = F.array_sort(
        F.transform(
            entries, lambda e: F.struct((-e["n"]).alias("rank"), e["value"].alias("value"))
        )
    )
    return F.array_join(
        F.transform(
            ranked,
            lambda e: F.concat(e["value"], F.lit(" ("), (-e["rank"]).cast("string"), F.lit(")")),
        ),
        ", ",
    )


def quarter_name(time: Column | str) -> Column:
    """Such as ``1996q1``; null without a time."""
    column = as_column(time)
    return F.concat(F.year(column).cast("string"), F.lit("q"), F.quarter(column).cast("string"))
