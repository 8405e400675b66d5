"""Columns for reading loosely typed records strictly: fallbacks, booleans, numbers, exact rounding, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timbrel.functions.text import strip


def first_present(*columns: Column | str) -> Column:
    """The first of several places in which a field may stand; null and '' are absent. Null if all are."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def strict_boolean(c: Column | str, name: str = "value") -> Column:
    """'true' or 'false' in any case, white space around it ignored; anything else, null too, is an error when it is read."""
    low = F.lower(strip(c))
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False)).otherwise(F.raise_error(F.concat(F.lit(f"{name} is no boolean: "), F.coalesce(low, F.lit("null")))).cast("boolean"))


def whole_number(c: Column | str) -> Column:
    """Text to a bigint if it is a whole number with perhaps a sign and white space around it, else null."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))


def round_half_even(c: Column | str, places: int = 0) -> Column:
    """A double rounded by its exact binary value, halves to the even digit: 2.675 is a little less than its spelling and goes to 2.67.

    The product with the power of ten is taken with its rounding error (both factors split into
    halves of 26 bits), so the comparison with one half is exact; for |value| * 10**places below 2**51.
    Null, NaN and infinities stay. The result is the double nearest to the rounded decimal.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    ten = float(10**places)
    big = ten * 134217729.0
    s_hi = big - (big - ten)
    s_lo = ten - s_hi

    def of(v: Column) -> Column:
        part = v * 134217729.0
        hi = part - (part - v)
        lo = v - hi
        p = v * ten
        return F.struct(p.alias("p"), (((hi * s_hi - p) + hi * s_lo + lo * s_hi) + lo * s_lo).alias("e"), F.floor(p).cast("double").alias("f"))

    def nearest(t: Column) -> Column:
        d, odd = t["p"] - t["f"] - 0.5, F.pmod(t["f"], F.lit(2.0)) == 1.0
        up = (d > 0) | (d == 0) & ((t["e"] > 0) | (t["e"] == 0) & odd)
        # just below one half of the next number: -0.5 means that the product was rounded up to a whole number
        return (t["f"] + F.when(up, 1.0).otherwise(0.0)) / ten

    # bound to lambda variables, so that each step is computed once
    exact = F.get(F.transform(F.transform(F.array(x), of), nearest), 0)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) >= 2.0**51 / ten), x).otherwise(exact)


def canonical_json(**fields: Column | str) -> Column:
    """Compact JSON with the fields in the order of their names, nulls written: one text for one record."""
    return F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def short_status(length: Column | str, duration: Column | str, short: int = 5000, brief: int = 600, slow: float = 2.0) -> Column:
    """Whether a transcript is suspiciously short for its video: by characters, seconds, and characters a second."""
    n, s = (F.col(x) if isinstance(x, str) else x for x in (length, duration))
    pace = n / F.nullif(s, F.lit(0))
    return (
        F.when(n >= short, "not_short")
        .when(pace.isNull(), "manual_review_missing_duration")
        .when((s <= brief) & (pace >= slow), "likely_valid_short_video")
        .when((s > brief) & (pace < slow), "possible_incomplete")
        .otherwise("manual_review")
    )
