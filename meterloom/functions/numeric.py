"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tidy(value, digits: int = 6) -> Column:
    """Round for display; a nudge far below the last digit keeps summation-order
    noise from deciding exact halves."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col + F.lit(10.0 ** -(digits + 3)), digits)


def safe_ratio(top, bottom) -> Column:
    """top / bottom, 0 where the ratio is undefined."""
    top, bottom = _c(top), _c(bottom)
    return F.coalesce(top / F.nullif(bottom, F.lit(0.0)), F.lit(0.0))


def floor_zero(value) -> Column:
    return F.greatest(_c(value), F.lit(0.0))


def clamp(value, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), _c(value)))


def minmax(value, low, high) -> Column:
    """Scale to 0..1 of [low, high]; a constant series scales to 0."""
    return safe_ratio(_c(value) - _c(low), _c(high) - _c(low))


def minmax_inverse(scaled, low, high) -> Column:
    return _c(scaled) * (_c(high) - _c(low)) + _c(low)


def nan_to_null(value) -> Column:
    return F.when(~F.isnan(_c(value)), _c(value))


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
