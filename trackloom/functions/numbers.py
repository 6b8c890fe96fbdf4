"""Numeric guards and rounding shared by all expressions. Angles are degrees, lengths metres."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: Column | float | int) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def clamp(x: Column, low: float, high: float) -> Column:
    """x within the limits; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def clamp_or(x: Column, low: float, high: float, default: float) -> Column:
    """x within its limits; the default where x is missing or not finite."""
    return clamp(F.coalesce(finite(x), F.lit(float(default))), low, high)


def fixed(x: Column, digits: int) -> Column:
    """Rounds half up at a decimal place, by the same double arithmetic in every engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def or_one(x: Column) -> Column:
    """x, or 1 where it is missing or zero."""
    return F.when(finite(x).isNull() | (x == 0), 1.0).otherwise(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body's value where it names another one several times: that is put once into the plan and computed once a row."""
    return F.transform(F.array(value), body)[0]
