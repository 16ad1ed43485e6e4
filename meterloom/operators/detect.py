"""Anomaly detectors. Each returns alert rows, ready for the alert table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterloom.functions.numeric import tidy
from meterloom.functions.severity import alert_id, alert_type, dedup_key, severity_tier
from meterloom.operators.features import backfill_std, rolling_stats
from meterloom.operators.recent import tail_per_series, trailing_range
from meterloom.operators.windows import ordered, whole

# Rolling windows, minimum counts and scan ranges.
HOURLY_ROWS, HOURLY_MIN = 168, 12
DAILY_ROWS, DAILY_MIN = 14, 3
SCAN_HOURS, SCAN_DAYS = 48, 14

ALERT_COLUMNS = (
    "alert_id", "series", "ts", "resource", "metric", "actual", "predicted", "residual",
    "sigma", "severity", "alert_type", "method",
)


def sigma_of(residual, std) -> Column:
    """|residual| in stds; 0 where the std is zero or unknown."""
    return F.coalesce(F.abs(residual) / F.nullif(std, F.lit(0.0)), F.lit(0.0))


def to_alerts(
    df: DataFrame, keys: Sequence[str], ts: str, resource: str, metric: Column, kind: Column | None = None
) -> DataFrame:
    """Rows of (actual, predicted, residual, sigma, method) that reach a severity tier."""
    rows = df.select(
        F.concat_ws("/", *keys).alias("series"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        F.lit(resource).alias("resource"),
        metric.alias("metric"),
        "actual",
        "predicted",
        "residual",
        "sigma",
        severity_tier("sigma").alias("severity"),
        "method",
    ).filter(F.col("severity").isNotNull())
    kind = alert_type("resource", "residual") if kind is None else kind
    made = {
        "alert_id": alert_id(dedup_key("resource", "metric", "series", "ts")),
        "alert_type": kind,
        **{c: tidy(c, 2) for c in ("actual", "predicted", "residual", "sigma")},
    }
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in ALERT_COLUMNS])


def with_lookback(df: DataFrame, keys: Sequence[str], ts: str, scan: int | None, rows: int) -> DataFrame:
    """The rows a scan of the last ``scan`` slots needs: its own and the frame before it.

    A series has at most one row per slot, so ``scan + 1`` rows cover the range, gaps
    or not, and the rolling statistics inside it come out as over the whole history.
    """
    if scan is None:
        return df
    return tail_per_series(df, keys, ts, scan + 1 + rows).drop("age")


def detect_energy(
    predictions: DataFrame,
    keys: Sequence[str],
    ts: str,
    metric: str,
    scan_hours: int | None = SCAN_HOURS,
    std_after_cut: bool = False,
) -> DataFrame:
    """Residuals against the hourly prediction over the scan range.

    The rolling std uses a week of history from before the range;
    ``std_after_cut=True`` computes it inside the range only.
    """
    rows = predictions.withColumn("residual", F.col("actual") - F.col("predicted"))
    if std_after_cut and scan_hours is not None:
        rows = trailing_range(rows, keys, ts, f"{scan_hours} hours")
    rows = rows.withColumn("_all_std", F.stddev_samp("residual").over(whole(keys)))
    if not std_after_cut:
        rows = with_lookback(rows, keys, ts, scan_hours, HOURLY_ROWS)
    rows = rolling_stats(rows, keys, ts, "residual", HOURLY_ROWS, HOURLY_MIN, std="_std")
    rows = backfill_std(rows, keys, ts, "_std").withColumn("_std", F.coalesce("_std", "_all_std"))
    if not std_after_cut and scan_hours is not None:
        rows = trailing_range(rows, keys, ts, f"{scan_hours} hours")
    scored = rows.withColumn("sigma", sigma_of(F.col("residual"), F.col("_std")))
    return to_alerts(scored, keys, ts, "energy", F.lit(metric))


# Alert type of the water detector by metric role.
WATER_ALERTS = {"flow": "water_spike", "pressure": "pressure_drop"}


def detect_water(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    metrics: Mapping[str, str],
    scan_hours: int | None = SCAN_HOURS,
) -> DataFrame:
    """Flow in both directions and pressure drops, against the rolling week.

    ``metrics`` maps a column to its role, ``flow`` or ``pressure``. The metrics are
    unpivoted first, so all of them share one shuffle and one sort.
    """
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in metrics)
    near = with_lookback(df, keys, ts, scan_hours, HOURLY_ROWS)
    long = near.select(*keys, ts, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, actual)"))
    by = [*keys, "metric"]
    rows = rolling_stats(long, by, ts, "actual", HOURLY_ROWS, HOURLY_MIN, "predicted", "_std")
    rows = rows.withColumn("_std", F.nullif("_std", F.lit(0.0)))
    rows = backfill_std(rows, by, ts, "_std").withColumn(
        "residual", F.col("actual") - F.col("predicted")
    )
    if scan_hours is not None:
        rows = trailing_range(rows, by, ts, f"{scan_hours} hours")
    drops = [c for c, role in metrics.items() if role == "pressure"]
    kind = F.when(F.col("metric").isin(*drops), WATER_ALERTS["pressure"]).otherwise(WATER_ALERTS["flow"])
    scored = (
        rows.withColumn("sigma", sigma_of(F.col("residual"), F.col("_std")))
        .withColumn("method", F.lit("rolling_stats"))
        .filter(~F.col("metric").isin(*drops) | (F.col("residual") < 0))
    )
    return to_alerts(scored, keys, ts, "water", F.col("metric"), kind)


def detect_waste(
    predictions: DataFrame,
    keys: Sequence[str],
    date: str,
    metric: str,
    scan_days: int | None = SCAN_DAYS,
) -> DataFrame:
    """Daily residuals against the prediction, in stds of the series' last two weeks."""
    rows = with_lookback(predictions, keys, date, scan_days, DAILY_ROWS)
    rows = rolling_stats(rows, keys, date, "actual", DAILY_ROWS, DAILY_MIN, std="_std")
    rows = rows.withColumn("_std", F.nullif("_std", F.lit(0.0)))
    rows = backfill_std(rows, keys, date, "_std").withColumn(
        "residual", F.col("actual") - F.greatest(F.col("predicted"), F.lit(0.0))
    )
    if scan_days is not None:
        rows = trailing_range(rows, keys, date, f"{scan_days} days")
    spread = F.coalesce("_std", F.stddev_samp("actual").over(whole(keys)))
    scored = rows.withColumn("sigma", sigma_of(F.col("residual"), spread))
    return to_alerts(scored, keys, date, "waste", F.lit(metric))


def residual_outliers(
    df: DataFrame, keys: Sequence[str], ts: str, population_std: bool = False
) -> DataFrame:
    """Chart rows whose deviation from the prediction exceeds two stds of all deviations."""
    gap = F.abs(F.col("actual") - F.col("predicted"))
    stat = F.stddev_pop if population_std else F.stddev_samp
    rows = df.withColumn("deviation", gap).withColumns(
        {
            "idx": F.row_number().over(ordered(keys, ts)) - 1,
            "deviation_std": stat("deviation").over(whole(keys)),
        }
    )
    return rows.filter(F.col("deviation") > F.col("deviation_std") * 2)


def chart_energy_anomalies(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Outliers of an hourly chart (sample std)."""
    kind = F.when(F.col("actual") > F.col("predicted"), "Phantom Load").otherwise("Unusual Drop")
    return residual_outliers(df, keys, ts).withColumns({"type": kind, "severity": F.lit("high")})


def _chart_marks() -> tuple[Column, Column]:
    """Type and severity of a chart row whose ``deviation`` is an outlier."""
    sigma = F.col("deviation") / (F.col("deviation_std") + 1e-9)
    kind = F.when(F.col("actual") > F.col("predicted"), "High Spike").otherwise("Unusual Drop")
    return kind, F.when(sigma >= 3, "critical").when(sigma >= 2, "high").otherwise("medium")


def chart_water_anomalies(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Outliers of a daily chart (population std), tiered by their size in stds."""
    kind, tier = _chart_marks()
    return residual_outliers(df, keys, date, population_std=True).withColumns({"type": kind, "severity": tier})


def charted_water(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Every row of a daily chart with its number; outliers have their type and severity."""
    kind, tier = _chart_marks()
    marked = df.withColumn("deviation", F.abs(F.col("actual") - F.col("predicted"))).withColumns(
        {"idx": F.row_number().over(ordered(keys, date)) - 1, "deviation_std": F.stddev_pop("deviation").over(whole(keys))}
    )
    out = F.col("deviation") > F.col("deviation_std") * 2
    return marked.select(*keys, date, "idx", "actual", "predicted", F.when(out, kind).alias("type"), F.when(out, tier).alias("severity"))
