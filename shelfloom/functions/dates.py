"""Dates: strict days, years in free text, precision, months, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a month's name or its first three letters.
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: The four shapes of a publication date that name one year.
YEAR_SHAPES = (
    r"^(\d{4})$",
    r"^(\d{4})-(?:0?[1-9]|1[0-2])(?:-(?:0?[1-9]|[12]\d|3[01]))?$",
    rf"(?i)^{MONTH}(?:\s+\d{{1,2}},?)?\s+(\d{{4}})$",
    rf"(?i)^\d{{1,2}}\s+{MONTH}\s+(\d{{4}})$",
)


def strict_day(value: Column) -> Column:
    """The date if value is a real yyyy-mm-dd day, else null."""
    return F.when(F.regexp_like(value, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(value, "yyyy-MM-dd"))


def year_in(value: Column, latest: int) -> Column:
    """The one year that a free-text date names, from 1000 to `latest`."""
    text, found = F.trim(value), F.lit(None).cast("int")
    for shape in reversed(YEAR_SHAPES):
        year = F.regexp_extract(text, shape, 1).try_cast("int")
        found = F.when(year.between(1000, latest), year).otherwise(found)
    return found


def single_year(value: Column, latest: int) -> Column:
    """The year if exactly one distinct number of 1500 to 2100 stands in the text."""
    years = F.array_distinct(F.regexp_extract_all(value, F.lit(r"\b(1[5-9]\d\d|20\d\d|2100)\b"), F.lit(1)))
    year = F.get(years, F.lit(0)).try_cast("int")
    return F.when((F.size(years) == 1) & (year <= latest), year)


def precision(value: Column, year: Column) -> Column:
    partial = (F.coalesce(F.trim(value), F.lit("")) != "") | year.isNotNull()
    return F.when(strict_day(value).isNotNull(), "exact_day").when(partial, "year_or_partial").otherwise("unknown")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_title(day: Column) -> Column:
    return F.concat(F.date_format(day, "MMMM yyyy"), F.lit(" Reading Challenge"))


def month_grid(month: Column) -> Column:
    """The 42 days from the Monday on or before the first of the month."""
    first = F.trunc(month, "month")
    start = F.date_sub(first, F.weekday(first))
    return F.sequence(start, F.date_add(start, 41))


def sync_window(as_of: Column, past: int = 90, ahead: int = 180) -> tuple[Column, Column]:
    """The days that a feed is asked for by default."""
    return F.date_sub(as_of, past), F.date_add(as_of, ahead)


def year_agrees(day: Column, year: Column) -> Column:
    return day.isNull() | year.isNull() | (F.year(day) == year)
