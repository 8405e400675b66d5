"""Column helpers whose behaviour on Unicode white space and instants is fixed in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An instant must name its zone; the parts between date, time and zone may be spelt several ways.
INSTANT = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d([.,]\d{1,9})?)? ?(Z|[+-]\d\d(:?\d\d)?)$"


def strip(c: Column | str) -> Column:
    """Remove Unicode white space at both ends (plain trim removes U+0020 only). Null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """One blank for each run of Unicode white space, none at the ends; null becomes ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def casefold(c: Column | str) -> Column:
    """Full case folding by built-in functions ('ß' and 'ẞ' to 'ss', every sigma alike), which lower() lacks.

    Capitals first, then small letters, with what differs from folding set right in between. Alike for
    all letters but the dotless i, Cherokee, and letters younger than the JVM's or Python's tables.
    """
    up = F.replace(F.upper(c), F.lit("\u1e9e"), F.lit("SS"))
    return F.translate(F.lower(up), "\u03c2", "\u03c3")


def instant_micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a zoned ISO-8601 spelling; null if it names no instant.

    'T' or a blank between date and time, 'Z', 'UTC' or an offset with or without colon, a dot or
    comma before the fraction, and either case are the same instant. Text without a zone is
    unreadable.
    """
    s = F.regexp_replace(F.upper(strip(c)), r"(UTC|GMT)$", "Z")
    s = F.when(s.rlike(INSTANT), s)
    s = F.regexp_replace(s, r" ?(Z|[+-]\d\d(:?\d\d)?)$", "$1")
    s = F.regexp_replace(F.regexp_replace(s, ",", "."), r"([+-]\d\d)(\d\d)$", "$1:$2")
    s = F.regexp_replace(s, r"([+-]\d\d)$", "$1:00")
    # a bare date ends in -dd too, but INSTANT has already required a time of day
    return F.unix_micros(s.try_cast("timestamp"))


def millis(c: Column | str) -> Column:
    """Seconds held as DOUBLE to whole milliseconds; null for null, NaN and infinities."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < 1e15), F.round(c * 1000).cast("bigint"))
