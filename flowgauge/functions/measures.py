"""Numeric expressions of the window aggregate and of the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def congestion_index(total: Column, speed: Column) -> Column:
    """Vehicles per km/h, NULL at a standstill."""
    return F.try_divide(total, speed)


def congestion_score(total: Column, speed: Column) -> Column:
    """Same ratio for the report, where a standstill with traffic outranks everything:
    infinite when vehicles queue at speed 0, NULL when there is neither speed nor traffic."""
    standstill = (speed == 0) & (total > 0)
    return F.when(standstill, F.lit(float("inf"))).otherwise(F.try_divide(total, speed))


def round_cents(value: Column) -> Column:
    """Two places, half to even, by the exact value of the double: 0.125 gives 0.12, and 2.675,
    which is stored a little below, 2.67.

    Only values near a whole and odd number of half cents are in doubt. There, the distance to it
    is taken exactly: `product` and `rest` are a thousand times the value without rounding error,
    by splitting the value into two halves of 26 bits.
    """
    product = value * 1000.0
    whole = F.rint(product)
    split = value * 134217729.0
    high = split - (split - value)
    rest = (high * 1000.0 - product) + (value - high) * 1000.0
    beyond = (product - whole) + rest
    below = F.floor(F.abs(whole) / 10.0)
    away = F.when(whole < 0, -beyond).otherwise(beyond)
    up = (away > 0) | ((away == 0) & (below % 2 == 1))
    near = F.signum(whole) * (below + F.when(up, 1.0).otherwise(0.0)) / 100.0
    doubtful = (F.abs(whole) % 10.0 == 5.0) & (F.abs(value) < 1e10)
    return F.when(doubtful, near).otherwise(F.rint(value * 100.0) / 100.0)


def round_half_even(value: Column, places: int = 2) -> Column:
    """Rounds the scaled value half to even; F.round would turn 0.125 into 0.13."""
    scale = float(10**places)
    return F.rint(value * scale) / scale
