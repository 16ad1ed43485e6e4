"""Display text: titles, labels, units, signed figures, ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meterloom.functions.timeparts import epoch_seconds

# Alert labels and resource units shown to people.
ALERT_LABELS = {
    "phantom_load": "Phantom Load",
    "unusual_drop": "Unusual Drop",
    "water_spike": "Water Spike",
    "pressure_drop": "Pressure Drop",
    "waste_spike": "Waste Spike",
    "waste_drop": "Waste Drop",
}
RESOURCE_UNITS = {"energy": "kWh", "water": "Gal", "waste": "lbs"}


def title_words(value) -> Column:
    """``phantom_load`` → ``Phantom Load``."""
    return F.initcap(F.replace(F.col(value) if isinstance(value, str) else value, F.lit("_"), F.lit(" ")))


def _lookup(value: Column, table: dict[str, str], default: Column) -> Column:
    out = default
    for key, label in table.items():
        out = F.when(value == key, label).otherwise(out)
    return out


def alert_label(kind: str) -> Column:
    return _lookup(F.col(kind), ALERT_LABELS, F.col(kind))


def resource_unit(resource: str) -> Column:
    return _lookup(F.col(resource), RESOURCE_UNITS, F.lit("lbs"))


def whole_number(value) -> Column:
    """Grouped digits, no decimals."""
    return F.format_number(_c(value), 0)


def signed(value, text: Column) -> Column:
    return F.when(_c(value) > 0, F.concat(F.lit("+"), text)).otherwise(text)


def currency(value) -> Column:
    return F.concat(F.lit("$"), whole_number(value))


def decimal_text(value, digits: int) -> Column:
    """Fixed decimals, halves to even, no grouping."""
    return F.replace(F.format_number(_c(value), digits), F.lit(","), F.lit(""))


def percent_text(value, digits: int = 1) -> Column:
    return F.concat(decimal_text(value, digits), F.lit("%"))


def relative_age(ts, now) -> Column:
    """``just now`` / ``5m ago`` / ``3h ago`` / ``2d ago``."""
    minutes = F.floor((epoch_seconds(now) - epoch_seconds(ts)) / 60)
    hours = F.floor(minutes / 60)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(minutes < 2, "just now")
        .when(minutes < 60, ago(minutes, "m"))
        .when(hours < 24, ago(hours, "h"))
        .otherwise(ago(F.floor(hours / 24), "d"))
    )


def chart_hour(ts) -> Column:
    """``09 AM``"""
    hour = F.lpad(((F.hour(ts) + 11) % 12 + 1).cast("string"), 2, "0")
    return F.concat_ws(" ", hour, F.when(F.hour(ts) < 12, "AM").otherwise("PM"))


def chart_day(ts) -> Column:
    """``Jan 05``"""
    return F.date_format(F.to_date(ts), "MMM dd")


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
