"""ISBN columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(text: Column, place: Column) -> Column:
    return F.substring(text, place, F.lit(1)).try_cast("int")


def _checksum13(text: Column, digits: int) -> Column:
    places = F.sequence(F.lit(1), F.lit(digits))
    return F.aggregate(places, F.lit(0), lambda s, i: s + _digit(text, i) * F.when(i % 2 == 0, 3).otherwise(1))


def isbn13(value: Column) -> Column:
    """The value without spaces and hyphens if it is an ISBN-13, else null."""
    bare = F.regexp_replace(value, "[ -]", "")
    return F.when(F.regexp_like(bare, F.lit(r"^97[89]\d{10}$")) & (_checksum13(bare, 13) % 10 == 0), bare)


def isbn10_to_13(value: Column) -> Column:
    """The ISBN-13 of a valid ISBN-10, else null."""
    bare = F.upper(F.regexp_replace(value, "[ -]", ""))
    weigh = lambda s, i: s + F.when(F.substring(bare, i, F.lit(1)) == "X", 10).otherwise(_digit(bare, i)) * (11 - i)
    valid = F.regexp_like(bare, F.lit(r"^\d{9}[\dX]$")) & (F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), weigh) % 11 == 0)
    twelve = F.concat(F.lit("978"), F.left(bare, F.lit(9)))
    return F.when(valid, F.concat(twelve, ((10 - _checksum13(twelve, 12) % 10) % 10).cast("string")))


def valid_isbns(isbn_13: Column, isbn_10: Column) -> Column:
    """Sorted distinct ISBN-13s of both lists."""
    none = F.array().cast("array<string>")
    every = F.concat(F.transform(F.coalesce(isbn_13, none), isbn13), F.transform(F.coalesce(isbn_10, none), isbn10_to_13))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull())))


def invalid_isbns(isbn_13: Column, isbn_10: Column) -> Column:
    """How many values of both lists are no ISBN."""
    none = F.array().cast("array<string>")
    bad = lambda values, read: F.size(F.filter(F.coalesce(values, none), lambda x: read(x).isNull()))
    return bad(isbn_13, isbn13) + bad(isbn_10, isbn10_to_13)
