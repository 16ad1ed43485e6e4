"""Calendar expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: months in which classes are held.
SCHOOL_MONTHS = (1, 2, 3, 4, 5, 9, 10, 11, 12)


def floor_hour(ts) -> Column:
    """Start of the hour, keeping TIMESTAMP_NTZ (date_trunc would turn it zoned)."""
    return F.timestamp_add("HOUR", F.hour(ts), F.to_date(ts).cast("timestamp_ntz"))


def day_start(ts) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def hour_number(ts) -> Column:
    """Whole hours since the epoch as an integer."""
    return F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts)


def epoch_seconds(ts) -> Column:
    """Whole seconds since the epoch, reading the clock time as it stands."""
    return hour_number(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def iso_text(ts) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of a clock time, with the fraction if it has one."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.replace(col.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))


def to_instant(ts) -> Column:
    """Clock time as a zoned instant (read as UTC), for watermarks; whole seconds."""
    return F.timestamp_seconds(epoch_seconds(ts))


def from_instant(instant) -> Column:
    """Inverse of ``to_instant``."""
    return F.timestamp_add("SECOND", F.unix_seconds(instant), F.lit("1970-01-01").cast("timestamp_ntz"))


def weekday(ts) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(ts)


def is_weekend(ts) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def is_school_session(ts) -> Column:
    return F.month(ts).isin(*SCHOOL_MONTHS).cast("int")


def is_business_hours(ts) -> Column:
    return ((F.hour(ts) >= 8) & (F.hour(ts) < 18) & (F.weekday(ts) < 5)).cast("int")


def calendar_columns(ts: str, hourly: bool) -> dict[str, Column]:
    """Calendar features by name, for an hourly or a daily frame."""
    common = {
        "day_of_week": weekday(ts),
        "day_name": F.date_format(F.to_date(ts), "EEEE"),
        "month": F.month(ts),
        "week_of_year": F.weekofyear(ts),
        "is_weekend": is_weekend(ts),
        "is_school_session": is_school_session(ts),
    }
    if hourly:
        return {"hour": F.hour(ts), **common, "is_business_hours": is_business_hours(ts)}
    return {**common, "quarter": F.quarter(ts)}
