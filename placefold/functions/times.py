"""Time arithmetic on TIMESTAMP_NTZ columns, free of session time zones."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def millis_between(start: Column, end: Column) -> Column:
    """Milliseconds from ``start`` to ``end`` as bigint."""
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return F.floor(seconds * 1000).cast("bigint")


def plus_seconds(c: Column, seconds: Column | int | float) -> Column:
    amount = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return c + F.make_dt_interval(secs=amount.cast("decimal(18,6)"))


def round_places(c: Column, places: int = 2) -> Column:
    """Nearest decimal to the exact binary value of a double, exact ties away from zero.

    A product alone may land on a tie that the value is not on (1.115 is a bit
    less than it looks). The part that the product loses is got back by
    splitting the value into two halves, and decides such ties.
    """
    scale = F.lit(float(10**places))
    x = F.abs(c)
    product = x * scale
    big = x * F.lit(134217729.0)  # 2^27 + 1
    high = big - (big - x)
    lost = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    part = product - whole
    up = (part > F.lit(0.5)) | ((part == F.lit(0.5)) & (lost >= F.lit(0.0)))
    return F.signum(c) * (whole + F.when(up, 1).otherwise(0)) / scale


def as_instant(c: Column) -> Column:
    """A zone-free time read as UTC: event times of streams have to be instants."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", ntz("1970-01-01"), c))


def as_zone_free(c: Column) -> Column:
    """The inverse of ``as_instant``, whatever the session's time zone."""
    return plus_seconds(ntz("1970-01-01"), F.unix_micros(c).cast("decimal(18,0)") * F.lit(Decimal("0.000001")))
