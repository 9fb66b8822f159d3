"""Selection of documents by origin, status, type and period; facets and search of the history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "Todos"


def by_origin(df: DataFrame, origin: str, col: str = "origin") -> DataFrame:
    return df.filter(F.col(col) == origin)


def by_status(df: DataFrame, status: str, col: str = "estado") -> DataFrame:
    """Rows of unknown status pass."""
    return df.filter(F.col(col).isNull() | (F.col(col) == status))


def by_period(df: DataFrame, start: Column, end: Column, issued: str = "fecha", authorized: str | None = None) -> DataFrame:
    """Inclusive range of the issue date, else of the authorization date; rows without a date go."""
    day = F.coalesce(issued, authorized) if authorized else F.col(issued)
    return df.filter(day.between(start, end))


def in_month(df: DataFrame, year: int, first: int | None = None, last: int | None = None, day: int = 0, col: str = "fecha") -> DataFrame:
    """A year (no months), a range of months, a month, or a day of it (0: all days)."""
    match = F.year(col) == year
    if first is not None:
        match &= F.month(col).between(first, last if last is not None else first)
        if last is None and day:
            match &= F.dayofmonth(col) == day
    return df.filter(match)


def clip(start: Column, end: Column, today: Column) -> tuple[Column, Column]:
    """A period up to today; its end is before its start if the period is in the future."""
    return start, F.least(end, today)


def older_than(df: DataFrame, days: int, today: Column, col: str = "fecha") -> DataFrame:
    return df.filter(F.datediff(today, F.col(col)) > days)


def facets(df: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """Rows that have all chosen values, compared as text; 'Todos' is no choice."""
    tests = [F.col(c).cast("string") == v for c, v in chosen.items() if v != ALL and c in df.columns]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def options(df: DataFrame, col: str, numeric: bool = False) -> DataFrame:
    """The values to choose from: distinct, not blank, in order."""
    values = df.select(F.trim(F.col(col).cast("string")).alias("option")).filter("option != ''").distinct()
    return values.orderBy(F.expr("try_cast(option as bigint)"), "option") if numeric else values.orderBy("option")


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in one of the columns or across their seams, without regard to case."""
    whole = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.filter(F.contains(whole, F.lit(text.lower())))


def newest_first(df: DataFrame, time: str, tie: str, number: str = "n") -> DataFrame:
    """All rows numbered from the newest on (ties: by ``tie``), without bringing them together.

    Rows are numbered within their day; the days' counts, one row for each day, say how many rows are newer.
    """
    daily = df.withColumn("_day", F.to_date(time))
    days = daily.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)  # of a row for each day
    before = days.select("_day", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_before"))
    ranked = daily.withColumn("_rank", F.row_number().over(Window.partitionBy("_day").orderBy(F.desc(time), tie)))
    met = ranked.alias("r").join(before.alias("b"), F.col("r._day").eqNullSafe(F.col("b._day")))
    return met.select((F.col("_before") + F.col("_rank")).alias(number), *[F.col(f"r.{c}") for c in df.columns])
