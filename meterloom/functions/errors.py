"""Forecast error measures as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mape(actual: str, predicted: str) -> Column:
    """Mean absolute percentage error; zero actuals are left out."""
    return F.avg(F.abs((F.col(actual) - F.col(predicted)) / F.nullif(F.col(actual), F.lit(0.0)))) * 100


def mae(actual: str, predicted: str) -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(predicted)))


def rmse(actual: str, predicted: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(actual) - F.col(predicted), F.lit(2.0))))
