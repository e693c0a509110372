"""Column expressions over numbers and dates: coercion that never raises, hashing, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(col: Column | str) -> Column:
    """Numeric text as double, anything else null."""
    return (F.col(col) if isinstance(col, str) else col).try_cast("double")


def to_timestamp(col: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Text in one declared format as timestamp, anything else null.

    Days in plain ISO form are cast, which costs a part of what the format's parser does; it gets the other texts.
    """
    parsed = F.try_to_timestamp(col, F.lit(fmt))
    if fmt != "yyyy-MM-dd":
        return parsed
    day = F.col(col) if isinstance(col, str) else col
    return F.when(day.rlike("^[12][0-9]{3}-[0-9]{2}-[0-9]{2}\\z"), day.try_cast("date").cast("timestamp")).otherwise(parsed)


def true_or_false(predicate: Column) -> Column:
    """A predicate over nulls counts as not met."""
    return F.coalesce(predicate, F.lit(False))


def unit_hash(col: Column | str, buckets: int = 10_000) -> Column:
    """Bucket in [0, buckets) that depends on the value alone, so it is stable under repartitioning."""
    digest = F.conv(F.substring(F.md5(F.col(col) if isinstance(col, str) else col), 1, 8), 16, 10)
    return F.pmod(digest.cast("long"), F.lit(buckets)).cast("int")


def np_round(col: Column | str, digits: int) -> Column:
    """Round as arrays do: scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint((F.col(col) if isinstance(col, str) else col) * scale) / scale


def py_round(col: Column | str, digits: int) -> Column:
    """Round the exact binary value half to even, as Python's ``round`` and number formats do.

    ``bround`` rounds the shortest decimal text instead, and scaling first can create or hide a tie.
    Here the rounding error of the scaled value is computed exactly (split product), and decides
    whenever the scaled value looks like a tie.
    """
    x = F.col(col) if isinstance(col, str) else col
    scale = float(10**digits)
    scaled = x * scale
    whole = F.floor(scaled).cast("double")
    part = scaled - whole
    spread = x * 134217729.0
    high = spread - (spread - x)
    error = (high * scale - scaled) + (x - high) * scale
    tie_up = (error > 0) | ((error == 0) & (whole % 2 != 0))
    up = (part > 0.5) | ((part == 0.5) & tie_up)
    return F.when(up, whole + 1.0).otherwise(whole) / scale


def fixed(col: Column | str, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded like Python's format."""
    return F.format_string(f"%.{digits}f", py_round(col, digits))
