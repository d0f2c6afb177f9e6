"""Row-wise helpers with the panel's rules for missing and infinite values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_inf(x: Column) -> Column:
    """Infinite and not-a-number values become missing."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_div(a: Column, b: Column) -> Column:
    """Missing for a denominator within 1e-12 of zero, or an infinite result."""
    return replace_inf(F.when(F.abs(b) > 1e-12, a / b))


def indicator(condition: Column) -> Column:
    """1 or 0; a missing condition is false."""
    return F.when(condition, 1.0).otherwise(0.0)


def select(condition: Column, a: Column, b: Column) -> Column:
    """a where the condition holds, else b, also where it is missing."""
    return F.when(condition, a).otherwise(b)


def element_max(a: Column, b: Column) -> Column:
    """Missing if either side is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def element_min(a: Column, b: Column) -> Column:
    """Missing if either side is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    """Missing stays missing."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def signed_power(x: Column, e: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(e))


def valid(*xs: Column) -> Column:
    """Whether all are there."""
    out = F.lit(True)
    for x in xs:
        out = out & x.isNotNull()
    return out


def told(condition: Column) -> Column:
    """A condition, false where it is missing; for comparisons, and for any of and/or/not over them."""
    return F.coalesce(condition, F.lit(False))


def mask(condition: Column, x: Column) -> Column:
    """x where the condition holds, else missing."""
    return F.when(condition, x)


def set_inf(x: Column, value: float = 0.0) -> Column:
    """Infinite and missing values become value."""
    return F.coalesce(replace_inf(x), F.lit(value))


def root(x: Column) -> Column:
    """Missing below 0."""
    return F.when(x >= 0, F.sqrt(x))


def log(x: Column) -> Column:
    """Missing at 0 and below."""
    return F.when(x > 0, F.ln(x))


def power(x: Column, e: float) -> Column:
    """Missing for a negative base with a fraction as exponent, and for infinite results."""
    return replace_inf(F.when((x >= 0) | F.lit(float(e).is_integer()), F.pow(x, F.lit(e))))


def mean_present(least: int, *xs: Column) -> Column:
    """The mean of those that are there, if at least so many are."""
    n = sum((indicator(x.isNotNull()) for x in xs), F.lit(0.0))
    return F.when(n >= least, F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)), n))


def growth(now: Column, before: Column) -> Column:
    """The relative change, for a positive base only."""
    return F.when(before > 0, F.try_divide(now, before) - 1)


def snap(x: Column, bits: int = 40, zero: float = 1e-12) -> Column:
    """Rounded to so many significant bits, so that values equal but for their last bits tie; tiny ones become 0.

    By a split: the sum of x and its multiple loses just the bits beyond. x stands outside of all conditions, so that Spark computes it once.
    """
    wide = x * float(2 ** (53 - bits) + 1)
    return F.nanvl(wide - (wide - x), x) * (F.abs(x) >= zero).cast("double") + 0.0
