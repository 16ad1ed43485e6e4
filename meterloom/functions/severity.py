"""Alert tiers, types and keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meterloom.functions.timeparts import day_start, floor_hour, iso_text

# Sigma thresholds, inclusive.
SIGMA_MEDIUM = 1.5
SIGMA_HIGH = 2.0
SIGMA_CRITICAL = 3.0

# Alert type by resource, for readings above / below what was expected.
ALERT_TYPES = {
    "energy": ("phantom_load", "unusual_drop"),
    "water": ("water_spike", "pressure_drop"),
    "waste": ("waste_spike", "waste_drop"),
}

# Display order of severities.
SEVERITY_ORDER = ("critical", "high", "medium", "low")


def severity_tier(sigma) -> Column:
    """Severity for a sigma magnitude, NULL below the lowest threshold."""
    s = F.col(sigma) if isinstance(sigma, str) else sigma
    return (
        F.when(s >= SIGMA_CRITICAL, "critical")
        .when(s >= SIGMA_HIGH, "high")
        .when(s >= SIGMA_MEDIUM, "medium")
    )


def severity_rank(severity) -> Column:
    s = F.col(severity) if isinstance(severity, str) else severity
    rank = F.lit(len(SEVERITY_ORDER))
    for position, name in reversed(list(enumerate(SEVERITY_ORDER[:3], start=1))):
        rank = F.when(s == name, position).otherwise(rank)
    return rank


def alert_type(resource, residual) -> Column:
    r = F.col(resource) if isinstance(resource, str) else resource
    d = F.col(residual) if isinstance(residual, str) else residual
    out = F.lit("anomaly")
    for name, (above, below) in ALERT_TYPES.items():
        out = F.when(r == name, F.when(d > 0, above).otherwise(below)).otherwise(out)
    return out


def alert_bucket(resource, ts) -> Column:
    """Hour for hourly resources, day for the rest."""
    r = F.col(resource) if isinstance(resource, str) else resource
    return F.when(r.isin("energy", "water"), floor_hour(ts)).otherwise(day_start(ts))


def dedup_key(resource: str, metric: str, series: str, ts: str) -> Column:
    """``resource|metric|series|bucket`` with an ISO bucket."""
    bucket = iso_text(alert_bucket(resource, ts))
    return F.concat_ws("|", resource, metric, series, bucket)


def alert_id(key) -> Column:
    return F.md5(F.col(key) if isinstance(key, str) else key)
