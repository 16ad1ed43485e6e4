"""Explicit schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STR, DBL, INT = T.StringType(), T.DoubleType(), T.IntegerType()
TS, DAY = T.TimestampNTZType(), T.DateType()

ENERGY = _schema(
    ("timestamp", TS), ("building", STR), ("energy_kwh", DBL), ("temperature_f", DBL),
    ("occupancy", INT),
)
WATER = _schema(("timestamp", TS), ("zone", STR), ("water_gallons", DBL), ("pressure_psi", DBL))
WASTE = _schema(
    ("date", DAY), ("total_waste_lbs", DBL), ("recycled_lbs", DBL), ("landfill_lbs", DBL),
    ("population_count", INT),
)
TRANSPORT = _schema(
    ("date", DAY), ("vehicle_type", STR), ("fuel_gallons", DBL), ("trips_count", INT),
    ("miles_driven", DBL),
)
EMISSION_FACTORS = _schema(
    ("resource_type", STR), ("unit", STR), ("co2e_kg_per_unit", DBL), ("source", STR)
)
ALERTS = _schema(
    ("alert_id", STR), ("series", STR), ("ts", TS), ("resource", STR), ("metric", STR),
    ("actual", DBL), ("predicted", DBL), ("residual", DBL), ("sigma", DBL), ("severity", STR),
    ("alert_type", STR), ("method", STR), ("status", STR), ("created_at", TS),
)
ALERT_EVENTS = _schema(("alert_id", STR), ("event", STR), ("at", TS))
METRICS = _schema(
    ("target", STR), ("model", STR), ("mape", DBL), ("mae", DBL), ("rmse", DBL),
    ("test_days", T.LongType()), ("trained_at", TS), ("top_feature", STR), ("backend", STR),
)
