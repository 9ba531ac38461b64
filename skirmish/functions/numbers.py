"""Rounding and ratio expressions with the semantics the statistics need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves towards plus infinity (-2.5 gives -2), where SQL's round() goes away from zero."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / F.lit(scale) if digits else F.floor(x + 0.5)


def half_away(x: Column, digits: int) -> Column:
    """Round halves away from zero, as SQL's round() of a double, without a decimal per row; for finite x * 10^digits below 2^63."""
    size = F.abs(x * 10.0**digits)
    whole = F.floor(size)
    return F.signum(x) * (whole + F.when(size - whole >= 0.5, 1).otherwise(0)) / 10.0**digits


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale * a / b, 0 where b is not positive."""
    return F.when(b > 0, scale * a / b).otherwise(F.lit(0.0))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(F.least(x, as_column(high)), as_column(low))


def buckets(x: Column, bounds: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first bound that x is below, else rest; null stays null."""
    out = F.when(x.isNotNull(), F.lit(rest))
    for bound, label in reversed(bounds):
        out = F.when(x < bound, F.lit(label)).otherwise(out)
    return out
