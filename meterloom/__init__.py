"""Metered-resource analytics on Spark: clean, roll up, forecast, detect, alert."""

__version__ = "0.1.0"
