"""Dates and periods, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxloom.catalogs import MONTHS
from taxloom.functions.text import fold

FORMATS = ["dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def timestamp(c: Column) -> Column:
    """Day-first or ISO text as a timestamp; null if it is none."""
    text = F.trim(F.regexp_replace(c, r"\s+", " "))

    def read(form: str) -> Column:
        """By one format, if the text has what the format can't do without; a failed try costs more than the one that succeeds."""
        timed = F.contains(text, F.lit(":"))
        return F.when(F.contains(text, F.lit("/" if "/" in form else "-")) & (timed if ":" in form else ~timed), F.try_to_timestamp(text, F.lit(form)))

    return F.coalesce(*[read(f) for f in FORMATS])


def day_first(c: Column) -> Column:
    """dd/MM/yyyy, of a date anywhere in the text with dashes or slashes; the time is kept if there is one; else empty."""
    found = F.regexp_extract(c, r"(\d{2}[/-]\d{2}[/-]\d{4}(\s+\d{2}:\d{2}(:\d{2})?)?)", 1)
    t = timestamp(F.replace(found, F.lit("-"), F.lit("/")))
    return F.coalesce(F.when(F.contains(found, F.lit(":")), F.date_format(t, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(t, "dd/MM/yyyy")), F.lit(""))


def date_slug(c: Column) -> Column:
    """yyyyMMdd of a day-first or ISO date in the text; empty if there is none."""
    t = timestamp(F.coalesce(F.nullif(F.regexp_extract(c, r"\d{2}/\d{2}/\d{4}", 0), F.lit("")), F.regexp_extract(c, r"\d{4}-\d{2}-\d{2}", 0)))
    return F.coalesce(F.date_format(t, "yyyyMMdd"), F.lit(""))


def month_number(c: Column) -> Column:
    """1 to 12 from a number or a month's name; null else."""
    text = F.lower(fold(F.trim(c)))
    names = F.array(*[F.lit(m.lower()) for m in MONTHS])
    return F.coalesce(F.when(text.try_cast("int").between(1, 12), text.try_cast("int")), F.nullif(F.array_position(names, text).cast("int"), F.lit(0)))


def month_name(c: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), c - 1)


def period(c: Column) -> Column:
    """(year, month, day) of a token yyyyMM, yyyyMMdd or ddMMyyyy; null if it is none."""
    d = F.regexp_replace(c, r"\D", "")

    def part(start: int, n: int) -> Column:
        return F.substring(d, start, n).try_cast("int")

    def ok(month: Column, day: Column) -> Column:
        return month.between(1, 12) & day.between(1, 31)

    def made(y: Column, m: Column, day: Column) -> Column:
        return F.struct(y.alias("year"), m.alias("month"), day.alias("day"))

    none = F.lit(None).cast("int")
    return (
        F.when((F.length(d) == 6) & part(5, 2).between(1, 12), made(part(1, 4), part(5, 2), none))
        .when((F.length(d) == 8) & ok(part(5, 2), part(7, 2)), made(part(1, 4), part(5, 2), part(7, 2)))
        .when((F.length(d) == 8) & ok(part(3, 2), part(1, 2)), made(part(5, 4), part(3, 2), part(1, 2)))
    )


def month_range(year: Column, month: Column) -> Column:
    """'01/MM/yyyy - last/MM/yyyy'."""
    first = F.make_date(year, month, F.lit(1))
    return F.concat_ws(" - ", F.date_format(first, "dd/MM/yyyy"), F.date_format(F.last_day(first), "dd/MM/yyyy"))
