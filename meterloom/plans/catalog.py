"""All registered queries and their oracles."""

from __future__ import annotations

from meterloom.plans import alerting, cleaning, features, forecasts, kpis, learned, served, streams  # noqa: F401  (registers on import)
from meterloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
