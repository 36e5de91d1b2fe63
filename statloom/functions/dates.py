"""Dates: seasons, many input formats, five-day buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Input formats in the order in which they are tried; the first that fits wins.
FORMATS = ("y-M-d", "M/d/y", "MMM d, y", "M-d-y", "d-M-y", "d/M/y")


def parse_date(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A date from text in the first format that fits; null if none does. Month names in any case."""
    named = F.initcap(F.lower(F.trim(text)))
    return F.coalesce(*[F.try_to_timestamp(named, F.lit(f)).cast("date") for f in formats])


def season_of(date: Column, first_month: int = 10) -> Column:
    """The season a date falls in, as 'YYYY-YY': from ``first_month`` on it is the one that starts that year."""
    start = F.when(F.month(date) >= first_month, F.year(date)).otherwise(F.year(date) - 1)
    return F.when(date.isNotNull(), F.format_string("%d-%02d", start, F.pmod(start + 1, F.lit(100))))


def bucket(date: Column, start: Column, days: int = 5) -> Column:
    """Number (from 0) of the window of ``days`` days, counted from ``start``, that holds a date."""
    return F.floor(F.datediff(date, start) / days).cast("int")


def season_start(date: Column, first_month: int = 10) -> Column:
    """The first day of the season that a date falls in."""
    return F.make_date(F.when(F.month(date) >= first_month, F.year(date)).otherwise(F.year(date) - 1), F.lit(first_month), F.lit(1))


def minutes_played(text: Column) -> Column:
    """Minutes from text such as '34:12' (minutes and seconds) or '34'; null for any other text."""
    whole, rest = (F.split_part(text, F.lit(":"), F.lit(k)).try_cast("double") for k in (1, 2))
    return F.when(F.contains(text, F.lit(":")), whole + rest / 60).otherwise(text.try_cast("double"))


def upper_date(date: Column) -> Column:
    """A date as 'APR 05, 2025'."""
    return F.upper(F.date_format(date, "MMM dd, yyyy"))
