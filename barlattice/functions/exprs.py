"""Column helpers used across operators; everything here stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY = 86_400


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a naive timestamp."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS))


def add_seconds(ts: str | Column, seconds: Column | float) -> Column:
    s = F.lit(seconds) if not isinstance(seconds, Column) else seconds
    return from_micros(micros(ts) + (s.cast("double") * F.lit(float(MICROS))).cast("long"))


def period_of(ts: str | Column, seconds: int = DAY) -> Column:
    """Number of the calendar period a timestamp falls in."""
    return F.floor(micros(ts) / F.lit(float(seconds * MICROS))).cast("long")


def floor_to(ts: str | Column, seconds: int) -> Column:
    return from_micros(period_of(ts, seconds) * F.lit(seconds * MICROS))


def finite(x: str | Column) -> Column:
    """Null for null, NaN and infinity."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def over_zero(num: Column, den: Column) -> Column:
    """Quotient, null when the denominator is 0."""
    return num / F.nullif(den, F.lit(0.0))


def rd(x: str | Column, digits: int) -> Column:
    return F.round(col(x).cast("double"), digits)


def half_even(x: Column) -> Column:
    """Round to a whole number, halves to even."""
    return F.bround(x, 0)


def loss(q: Column) -> Column:
    """A quantile or mean on the loss side as a positive magnitude, floored at 0."""
    return F.when(q.isNotNull(), F.greatest(F.lit(0.0), -q))


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def truthy(cond: Column) -> Column:
    """Null counts as true."""
    return F.coalesce(cond, F.lit(True))


def falsy(cond: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(cond, F.lit(False))
