"""Rounding and clipping of published values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_negative(value: Column) -> Column:
    """Clip at 0, leaving NULL as NULL."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def _half_even(value: Column, places: int) -> Column:
    """Half to even, where a sum taken in another order must not tip a half over."""
    return F.bround(F.round(value, 9), places)


def round_forecast(value: Column) -> Column:
    return _half_even(value, 1)


def round_metric(value: Column) -> Column:
    return _half_even(value, 2)
