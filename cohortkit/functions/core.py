"""Scalar column helpers shared by all operators (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start, end) -> Column:
    """Signed microseconds from ``start`` to ``end`` (works on timestamp_ntz)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def whole_days(start, end) -> Column:
    """Whole days from start to end, floored toward minus infinity (-5 h -> -1)."""
    return F.floor(micros_between(start, end) / F.lit(US_PER_DAY)).cast("bigint")


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def is_negative(c) -> Column:
    """True only for a real negative number; null/NaN count as not negative."""
    return F.coalesce(_c(c) < 0, F.lit(False))


def not_zero(c) -> Column:
    """pandas ``x != 0``: null counts as different from zero."""
    return ~(_c(c).eqNullSafe(F.lit(0)))


def fnum(c, digits: int = 6) -> Column:
    """Rounded double for value comparisons (summation order varies)."""
    return F.round(_c(c).cast("double"), digits)


def add_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row without a driver round trip.

    ``scalars`` must be a global aggregate (exactly one row), so the
    broadcast size is bounded by its column count.
    """
    return df.crossJoin(F.broadcast(scalars))


def idiv(a, b) -> Column:
    """Exact integer division (truncating; operands are non-negative here)."""
    return F.call_function("div", _c(a), _c(b))
