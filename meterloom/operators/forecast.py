"""Deterministic forecasts, hourly profiles and hold-out errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterloom.functions import errors
from meterloom.functions.timeparts import is_school_session, is_weekend
from meterloom.operators.recent import tail_per_series
from meterloom.operators.windows import ordered, trailing, whole

def check_horizon(periods: int) -> int:
    """``periods`` as asked for; a day or more."""
    if periods < 1:
        raise ValueError("periods must be positive")
    return periods


def future_dates(last: str, periods: int) -> Column:
    """Array of the ``periods`` days after ``last``."""
    return F.sequence(F.date_add(last, 1), F.date_add(last, periods))


def future_calendar(df: DataFrame, keys: Sequence[str], date: str, periods: int) -> DataFrame:
    """The next days of every series."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    return last.select(*keys, F.explode(future_dates("_last", check_horizon(periods))).alias(date))


def future_regressors(
    df: DataFrame, keys: Sequence[str], date: str, col: str, periods: int
) -> DataFrame:
    """Future days with the month's historical mean of ``col`` and calendar flags.

    The twelve month means travel as one array per series, so no lookup join.
    """
    means = F.array(*[F.avg(F.when(F.month(date) == m, F.col(col))) for m in range(1, 13)])
    known = df.groupBy(*keys).agg(
        means.alias("_means"), F.avg(col).alias("_mean"), F.max(date).alias("_last")
    )
    days = known.select(
        *keys,
        "_means",
        "_mean",
        F.explode(future_dates("_last", check_horizon(periods))).alias(date),
    )
    return days.select(
        *keys,
        date,
        F.month(date).alias("month"),
        F.coalesce(F.element_at("_means", F.month(date)), F.col("_mean")).alias(col),
        is_weekend(date).alias("is_weekend"),
        is_school_session(date).alias("is_school_session"),
    )


def forecast_flat(
    df: DataFrame, keys: Sequence[str], date: str, col: str, periods: int, margin: float
) -> DataFrame:
    """Mean of the last 7 rows, carried forward, with ± ``margin`` bounds."""
    level = (
        tail_per_series(df, keys, date, 7)
        .groupBy(*keys)
        .agg(F.avg(col).alias("forecast"), F.max(date).alias("_last"))
    )
    return level.select(
        *keys,
        F.explode(future_dates("_last", check_horizon(periods))).alias(date),
        "forecast",
        (F.col("forecast") * (1 - margin)).alias("lower"),
        (F.col("forecast") * (1 + margin)).alias("upper"),
        F.lit("rolling_mean").alias("method"),
    )


def forecast_seasonal_rolling(
    df: DataFrame, keys: Sequence[str], date: str, col: str, periods: int
) -> DataFrame:
    """Weekday mean of the last 28 rows, else the mean of the last 7; ± half a std.

    One aggregate per series carries the seven weekday means as an array.
    """
    by_day = F.array(*[F.avg(F.when(F.weekday(date) == d, F.col(col))) for d in range(7)])
    recent = (
        tail_per_series(df, keys, date, 28)
        .groupBy(*keys)
        .agg(
            by_day.alias("_by_day"),
            F.avg(F.when(F.col("age") <= 7, F.col(col))).alias("_level"),
            F.stddev_samp(col).alias("_std"),
            F.max(date).alias("_last"),
        )
    )
    days = recent.select(
        *recent.columns, F.explode(future_dates("_last", check_horizon(periods))).alias(date)
    ).withColumn(
        "forecast", F.coalesce(F.element_at("_by_day", F.weekday(date) + 1), F.col("_level"))
    )
    return days.select(
        *keys, date, "forecast", *half_std_bounds("forecast", "_std"),
        F.lit("seasonal_rolling").alias("method"),
    )


def half_std_bounds(forecast: str, std: str) -> list[Column]:
    """± 0.5 · std, the lower bound not below zero."""
    f, s = F.col(forecast), F.col(std)
    return [
        F.greatest(F.lit(0.0), f - s * 0.5).alias("lower"),
        (f + s * 0.5).alias("upper"),
    ]


def hourly_profile(df: DataFrame, keys: Sequence[str], ts: str, col: str) -> DataFrame:
    """Mean share of the day's total by hour, scaled to sum to 1 per series."""
    day_total = F.sum(col).over(whole([*keys, "_date"]))
    shares = df.withColumn("_date", F.to_date(ts)).select(
        *keys, F.hour(ts).alias("hour"), (F.col(col) / F.nullif(day_total, F.lit(0.0))).alias("_share")
    )
    means = shares.groupBy(*keys, "hour").agg(F.avg("_share").alias("_mean"))
    total = F.sum("_mean").over(whole(keys))
    return means.select(
        *keys,
        "hour",
        F.when(total > 0, F.col("_mean") / total).otherwise(F.lit(1.0 / 24)).alias("fraction"),
    )


def disaggregate_hourly(
    hourly: DataFrame,
    daily_forecast: DataFrame | None,
    profile: DataFrame | None,
    keys: Sequence[str],
    ts: str,
    col: str,
    share_missing: bool = False,
) -> DataFrame:
    """Actual and predicted per hour: the day's ``yhat`` times the hour's share.

    Without a daily forecast or profile, the trailing 3-row mean. A day without a
    forecast predicts the actual itself; ``share_missing=True`` multiplies that
    actual by the hour's share instead.
    """
    keep = [*keys, ts, F.col(col).alias("actual")]
    if daily_forecast is None or profile is None:
        mean3 = F.avg(col).over(trailing(keys, ts, 3))
        return hourly.select(
            *keep, mean3.alias("predicted"), F.lit("rolling_mean").alias("method")
        )
    days = daily_forecast.select(*keys, F.col("date").alias("_date"), "yhat")
    joined = (
        hourly.select(*keep, F.to_date(ts).alias("_date"), F.hour(ts).alias("hour"))
        .join(days, [*keys, "_date"], "left")
        .join(profile, [*keys, "hour"], "left")
    )
    spread = F.col("yhat") * F.col("fraction")
    fallback = F.col("actual") * F.col("fraction") if share_missing else F.col("actual")
    return joined.select(
        *keys,
        ts,
        "actual",
        F.coalesce(spread, fallback).alias("predicted"),
        F.when(spread.isNotNull(), "profile").otherwise("actual").alias("method"),
    )


def actual_vs_predicted(
    actual: DataFrame, predicted: DataFrame, keys: Sequence[str], ts: str, col: str
) -> DataFrame:
    """Actuals with their prediction; hours without one take the trailing 3-row mean."""
    mean3 = F.avg(col).over(trailing(keys, ts, 3))
    both = actual.select(*keys, ts, col, mean3.alias("_mean3")).join(
        predicted.select(*keys, ts, "predicted"), [*keys, ts], "left"
    )
    return both.select(
        *keys,
        ts,
        F.col(col).alias("actual"),
        F.coalesce("predicted", "_mean3").alias("predicted"),
        F.when(F.col("predicted").isNull(), "rolling_mean").otherwise("model").alias("method"),
    )


def naive_candidates(df: DataFrame, keys: Sequence[str], date: str, col: str) -> DataFrame:
    """One-step predictions from history alone: last week's value and last week's mean."""
    models = F.array(
        F.struct(F.lit("seasonal_naive").alias("model"), F.lag(col, 7).over(ordered(keys, date)).alias("predicted")),
        F.struct(
            F.lit("trailing_mean").alias("model"),
            F.avg(col).over(trailing(keys, date, 7, include_current=False)).alias("predicted"),
        ),
    )
    return (
        df.select(*keys, date, F.col(col).alias("actual"), models.alias("_models"))
        .withColumn("_m", F.explode("_models"))
        .select(*keys, date, "actual", F.col("_m.model"), F.col("_m.predicted"))
        .dropna(subset=["predicted"])
    )


def holdout_errors(predictions: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """MAPE, MAE and RMSE per group, with the number of test days."""
    return predictions.groupBy(*by).agg(
        errors.mape("actual", "predicted").alias("mape"),
        errors.mae("actual", "predicted").alias("mae"),
        errors.rmse("actual", "predicted").alias("rmse"),
        F.count_distinct(date).alias("test_days"),
    )


RETRAIN_ABOVE_MAPE = 10.0  # fixed value: a challenger is tried only above this error


def choose_champion(
    metrics: DataFrame, keys: Sequence[str], incumbent: str, challenger: str
) -> DataFrame:
    """The incumbent stays unless its MAPE is above the limit and the challenger's is lower."""
    of = lambda model: F.max(F.when(F.col("model") == model, F.col("mape")))
    both = metrics.groupBy(*keys).agg(
        of(incumbent).alias("incumbent_mape"), of(challenger).alias("challenger_mape")
    )
    wins = (F.col("incumbent_mape") > RETRAIN_ABOVE_MAPE) & (
        F.col("challenger_mape") < F.col("incumbent_mape")
    )
    return both.select(
        *keys,
        F.when(wins, challenger).otherwise(incumbent).alias("model"),
        F.when(wins, F.col("challenger_mape")).otherwise(F.col("incumbent_mape")).alias("mape"),
        (F.col("incumbent_mape") > RETRAIN_ABOVE_MAPE).cast("int").alias("challenger_tried"),
    )


MODEL_STATUS = {True: "Active", False: "Not Trained"}  # fixed values


def model_status(models: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every known (target, model) with its metrics, if it has been trained."""
    joined = models.join(metrics, ["target", "model"], "left")
    trained = F.col("mape").isNotNull()
    return joined.withColumns(
        {
            "status": F.when(trained, MODEL_STATUS[True]).otherwise(MODEL_STATUS[False]),
            "metric": F.when(trained, F.format_string("MAPE %.2f %%", F.col("mape"))),
        }
    )
