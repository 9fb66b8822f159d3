"""Amounts as text, Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal(c: Column, kind: str = "decimal(18,6)", compat: bool = False) -> Column:
    """A number from text with either decimal mark; null if there is none.

    The last of comma and point is the decimal mark and the other one separates thousands. With ``compat`` the text
    is tried as it is, then with points dropped and commas as decimal marks, then with commas dropped, so that
    '1,234.56' is 1.23456.
    """
    text = F.regexp_replace(F.trim(c), r"[\s ]", "")
    if compat:
        other = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return F.coalesce(text.try_cast(kind), other.try_cast(kind), F.replace(text, F.lit(","), F.lit("")).try_cast(kind))
    comma = F.length(text) - F.instr(F.reverse(text), ",")
    point = F.length(text) - F.instr(F.reverse(text), ".")
    comma_last = F.contains(text, F.lit(",")) & (~F.contains(text, F.lit(".")) | (comma > point))
    return F.when(comma_last, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(kind)).otherwise(F.replace(text, F.lit(","), F.lit("")).try_cast(kind))


def amount(c: Column, kind: str = "decimal(18,6)") -> Column:
    """As :func:`decimal`, 0 where there is no number."""
    return F.coalesce(decimal(c, kind), F.lit(0).cast(kind))


def amount_slug(c: Column) -> Column:
    """12.5 as '12_50'."""
    return F.replace(F.coalesce(c.cast("decimal(18,2)").cast("string"), F.lit("0.00")), F.lit("."), F.lit("_"))


def iva_column(tax: Column, base: Column) -> Column:
    """The rate column that tax / base falls in, within one point; null if none."""
    rate = tax / F.nullif(base, F.lit(0).cast("double"))
    rates = [("iva15", 0.15), ("iva12", 0.12), ("iva8", 0.08), ("iva5", 0.05)]
    found = reduce(lambda acc, x: acc.when(F.abs(rate - x[1]) <= 0.01, x[0]), rates[1:], F.when(F.abs(rate - rates[0][1]) <= 0.01, rates[0][0]))
    return F.when((tax != 0) & (base > 0), found)
