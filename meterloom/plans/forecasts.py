"""Deterministic forecast, profile and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.functions import text
from meterloom.functions.timeparts import iso_text
from meterloom.operators import forecast as ops
from meterloom.operators.clean import split_train_test
from meterloom.operators.windows import trailing
from meterloom.plans.base import (
    CUTOFF, KEY, SQL_DAILY, SQL_HOURLY, SQL_WASTE, daily, hourly, query, r, rounded, rs, saved, waste, with_,
)
from meterloom.session import scratch_path
from meterloom.sources.artifacts import load_metrics, save_metrics

# ---------------------------------------------------------------- future days

SQL_FUTURE = """
last_day AS (SELECT series, max(date) AS d FROM {src} GROUP BY ALL),
future_ts AS (SELECT series, unnest(generate_series(CAST(d + 1 AS TIMESTAMP), CAST(d + {periods} AS TIMESTAMP), INTERVAL 1 DAY)) AS u FROM last_day),
future AS (SELECT series, CAST(u AS DATE) AS date FROM future_ts)"""


@query("future_calendar", with_(SQL_WASTE, SQL_FUTURE.format(src="waste", periods=30), "SELECT * FROM future"))
def future_calendar(spark, sf):
    return ops.future_calendar(waste(spark, sf), KEY, "date", 30)


@query(
    "future_regressors",
    with_(
        SQL_DAILY, SQL_FUTURE.format(src="daily", periods=30),
        "mm AS (SELECT series, month(date) AS m, avg(level) AS level FROM daily GROUP BY ALL)",
        "am AS (SELECT series, avg(level) AS mean FROM daily GROUP BY ALL)",
        f"""SELECT f.series, f.date, CAST(month(f.date) AS INTEGER) AS month, {r('coalesce(mm.level, am.mean)')} AS level,
                   CAST(isodow(f.date) >= 6 AS INTEGER) AS is_weekend,
                   CAST(month(f.date) IN (1, 2, 3, 4, 5, 9, 10, 11, 12) AS INTEGER) AS is_school_session
            FROM future f LEFT JOIN mm ON mm.series = f.series AND mm.m = month(f.date) JOIN am ON am.series = f.series""",
    ),
)
def future_regressors(spark, sf):
    return rounded(ops.future_regressors(daily(spark, sf), KEY, "date", "level", 30))


SQL_SEASONAL = SQL_FUTURE.replace("{src}", "waste") + """,
s_age AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM waste),
s_dow AS (SELECT series, isodow(date) AS dow, avg(total) AS m FROM s_age WHERE age <= 28 GROUP BY ALL),
s_all AS (SELECT series, avg(total) FILTER (age <= 7) AS lvl, stddev_samp(total) AS sd FROM s_age WHERE age <= 28 GROUP BY ALL),
s_val AS (SELECT f.series, f.date, coalesce(s_dow.m, lvl) AS forecast, sd FROM future f
          LEFT JOIN s_dow ON s_dow.series = f.series AND s_dow.dow = isodow(f.date) JOIN s_all ON s_all.series = f.series),
seasonal AS (SELECT series, date, forecast, greatest(0, forecast - sd * 0.5) AS lower, forecast + sd * 0.5 AS upper,
                    'seasonal_rolling' AS method FROM s_val)"""


@query(
    "forecast_seasonal_rolling",
    with_(SQL_WASTE, SQL_SEASONAL.format(periods=14), f"SELECT series, date, method, {rs('forecast', 'lower', 'upper')} FROM seasonal"),
)
def forecast_seasonal_rolling(spark, sf):
    return rounded(ops.forecast_seasonal_rolling(waste(spark, sf), KEY, "date", "total", 14))


SQL_FLAT = SQL_FUTURE.replace("{src}", "waste").replace("{periods}", "7") + """,
f_age AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM waste),
f_avg AS (SELECT series, avg(total) AS forecast FROM f_age WHERE age <= 7 GROUP BY ALL),
flat AS (SELECT series, date, forecast, forecast * (1 - 0.15::DOUBLE) AS lower, forecast * (1 + 0.15::DOUBLE) AS upper
         FROM future JOIN f_avg USING (series))"""

# Half-width of the flat forecast's bounds by resource.
FLAT_MARGIN = {"energy": 0.10, "waste": 0.15}


@query("forecast_flat", with_(SQL_WASTE, SQL_FLAT, f"SELECT series, date, 'rolling_mean' AS method, {rs('forecast', 'lower', 'upper')} FROM flat"))
def forecast_flat(spark, sf):
    return rounded(ops.forecast_flat(waste(spark, sf), KEY, "date", "total", 7, FLAT_MARGIN["waste"]))


@query(
    "forecast_json",
    with_(
        SQL_WASTE, SQL_FLAT,
        f"""SELECT series, date, CAST(to_json({{'date': strftime(date, '%Y-%m-%d'), 'lbs_forecast': {r('forecast', 1)},
              'lbs_lower': {r('lower', 1)}, 'lbs_upper': {r('upper', 1)}, 'source': 'rolling_mean'}}) AS VARCHAR) AS document FROM flat""",
    ),
)
def forecast_json(spark, sf):
    flat = rounded(ops.forecast_flat(waste(spark, sf), KEY, "date", "total", 7, FLAT_MARGIN["waste"]), 1)
    record = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("forecast").alias("lbs_forecast"),
        F.col("lower").alias("lbs_lower"),
        F.col("upper").alias("lbs_upper"),
        F.col("method").alias("source"),
    )
    return flat.select("series", "date", F.to_json(record).alias("document"))


SQL_ERRORS = f"""
cand AS (
    SELECT series, date, total AS actual, 'seasonal_naive' AS model, lag(total, 7) OVER (PARTITION BY series ORDER BY date) AS predicted FROM waste
    UNION ALL
    SELECT series, date, total, 'trailing_mean', avg(total) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) FROM waste),
errs AS (SELECT series AS target, model, avg(abs((actual - predicted) / nullif(actual, 0))) * 100 AS mape,
                avg(abs(actual - predicted)) AS mae, sqrt(avg(pow(actual - predicted, 2))) AS rmse,
                count(DISTINCT date) AS test_days, max(date) AS trained_at
         FROM cand WHERE predicted IS NOT NULL AND date > DATE '{CUTOFF}' GROUP BY ALL)"""


def served_forecast(forecast, metrics, by="series"):
    """One document per series: the model and its metrics, and the days in order.

    ``metrics`` has (target, mape, trained_at) of the model that made the forecast.
    """
    day = F.struct("date", "forecast", "lower", "upper")
    rows = forecast.groupBy(by, "method").agg(F.sort_array(F.collect_list(day)).alias("days"))
    known = metrics.select(F.col("target").alias(by), "mape", "trained_at")
    return rows.join(known, by, "left").select(
        by, F.col("method").alias("model"), F.size("days").cast("long").alias("periods"), "mape", "trained_at", "days"
    )


@query(
    "forecast_document",
    with_(
        SQL_WASTE, SQL_ERRORS, SQL_FLAT,
        f"""SELECT series, 'rolling_mean' AS model, count(*) AS periods, any_value({r('mape')}) AS mape,
                   any_value(CAST(trained_at AS TIMESTAMP)) AS trained_at, min(date) AS first_day, max(date) AS last_day,
                   {r('sum(forecast)', 4)} AS total FROM flat LEFT JOIN errs ON target = series AND model = 'trailing_mean' GROUP BY series""",
    ),
)
def forecast_document(spark, sf):
    """The served document of the flat forecast, with its days summed up for comparison."""
    days = saved(waste(spark, sf).select("series", "date", "total"), "waste")
    metrics = holdout_metrics(days).filter("model = 'trailing_mean'")
    last = days.groupBy(F.col("series").alias("target")).agg(F.max("date").cast("timestamp_ntz").alias("trained_at"))
    flat = ops.forecast_flat(days, KEY, "date", "total", 7, FLAT_MARGIN["waste"])
    served = served_forecast(flat, metrics.join(last, "target"))
    total = F.aggregate(F.col("days.forecast"), F.lit(0.0), lambda a, v: a + v)
    return rounded(
        served.select(
            "series", "model", "periods", "mape", "trained_at", F.array_min("days.date").alias("first_day"),
            F.array_max("days.date").alias("last_day"), total.alias("total"),
        ),
        {"total": 4},
    )


# ---------------------------------------------------------------- profile and hourly prediction

SQL_PROFILE = """
day_total AS (SELECT series, ts, usage, sum(usage) OVER (PARTITION BY series, CAST(ts AS DATE)) AS t FROM hourly),
shares AS (SELECT series, hour(ts) AS hour, avg(usage / nullif(t, 0)) AS m FROM day_total GROUP BY ALL),
profile AS (SELECT series, hour, m / sum(m) OVER (PARTITION BY series) AS fraction FROM shares)"""
SQL_DAY_FORECAST = """
yhat AS (SELECT series, date, avg(usage) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS yhat FROM daily)"""
SQL_PREDICTED = SQL_PROFILE + "," + SQL_DAY_FORECAST + """,
predicted AS (SELECT h.series, h.ts, h.usage AS actual, coalesce(y.yhat * p.fraction, h.usage) AS predicted,
                     CASE WHEN y.yhat * p.fraction IS NULL THEN 'actual' ELSE 'profile' END AS method
              FROM hourly h LEFT JOIN yhat y ON y.series = h.series AND y.date = CAST(h.ts AS DATE)
              LEFT JOIN profile p ON p.series = h.series AND p.hour = hour(h.ts))"""


def hourly_usage(spark, sf):
    """Cleaned hourly usage, rolled up once for all branches of a plan."""
    return saved(hourly(spark, sf).select("series", "ts", "usage"), "hours")


def day_forecast(hours):
    """Daily forecast: mean of the seven days before, none for the first day."""
    from meterloom.operators.rollup import rollup

    days = rollup(hours, KEY, "ts", "day", {"usage": "usage"}, out_ts="date")
    before = trailing(KEY, "date", 7, include_current=False)
    return days.select("series", "date", F.avg("usage").over(before).alias("yhat"))


def predicted_hours(hours, share_missing: bool = False):
    """Actual and predicted usage of cleaned hours."""
    hours = hours.select("series", "ts", "usage")
    profile = ops.hourly_profile(hours, KEY, "ts", "usage")
    return ops.disaggregate_hourly(hours, day_forecast(hours), profile, KEY, "ts", "usage", share_missing)


@query(
    "hourly_profile",
    with_(SQL_HOURLY, SQL_PROFILE, f"SELECT series, CAST(hour AS INTEGER) AS hour, {r('fraction', 9)} AS fraction FROM profile"),
)
def hourly_profile(spark, sf):
    return rounded(ops.hourly_profile(hourly(spark, sf), KEY, "ts", "usage"), 9)


@query(
    "hourly_disaggregation",
    with_(SQL_DAILY, SQL_PREDICTED, f"SELECT series, ts, method, {rs('actual', 'predicted')} FROM predicted"),
)
def hourly_disaggregation(spark, sf):
    return rounded(predicted_hours(hourly_usage(spark, sf)))


@query(
    "hourly_prediction_fallback",
    with_(
        SQL_HOURLY,
        f"""SELECT series, ts, 'rolling_mean' AS method, {r('usage')} AS actual, {r('avg(usage) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS predicted FROM hourly""",
    ),
)
def hourly_prediction_fallback(spark, sf):
    """Without a model or profile: the trailing 3-hour mean."""
    return rounded(ops.disaggregate_hourly(hourly(spark, sf), None, None, KEY, "ts", "usage"))


SQL_AVP = SQL_PREDICTED + """,
avp AS (SELECT h.series, h.ts, h.usage AS actual, coalesce(p.predicted, avg(h.usage) OVER (
                 PARTITION BY h.series ORDER BY h.ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS predicted,
               CASE WHEN p.predicted IS NULL THEN 'rolling_mean' ELSE 'model' END AS method
        FROM hourly h LEFT JOIN (SELECT * FROM predicted WHERE method = 'profile') p USING (series, ts))"""


def chart_hours(spark, sf):
    hours = hourly_usage(spark, sf)
    model = predicted_hours(hours).filter("method = 'profile'")
    return ops.actual_vs_predicted(hours, model, KEY, "ts", "usage")


@query("actual_vs_predicted", with_(SQL_DAILY, SQL_AVP, f"SELECT series, ts, method, {rs('actual', 'predicted')} FROM avp"))
def actual_vs_predicted(spark, sf):
    """Hours of the first day have no model prediction and take the trailing mean."""
    return rounded(chart_hours(spark, sf))


@query(
    "chart_labels",
    with_(
        SQL_HOURLY,
        """SELECT series, ts, strftime(ts, '%I %p') AS hour_label, strftime(ts, '%b %d') AS day_label,
                  strftime(ts, '%Y-%m-%d') AS date_iso, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_iso FROM hourly""",
    ),
)
def chart_labels(spark, sf):
    return hourly(spark, sf).select(
        "series",
        "ts",
        text.chart_hour("ts").alias("hour_label"),
        text.chart_day("ts").alias("day_label"),
        F.to_date("ts").cast("string").alias("date_iso"),
        iso_text("ts").alias("ts_iso"),
    )


# ---------------------------------------------------------------- evaluation

def holdout_metrics(days):
    """Errors of the history-only candidates on the days after the cutoff."""
    found = ops.naive_candidates(days, KEY, "date", "total")
    _, test = split_train_test(found.withColumnRenamed("series", "target"), "date", CUTOFF)
    return ops.holdout_errors(test, ["target", "model"], "date")


SQL_ERROR_ROWS = f"SELECT target, model, {rs('mape', 'mae', 'rmse')}, test_days"


@query("forecast_errors", with_(SQL_WASTE, SQL_ERRORS, f"{SQL_ERROR_ROWS} FROM errs"))
def forecast_errors(spark, sf):
    return rounded(holdout_metrics(waste(spark, sf)))


@query(
    "metrics_roundtrip",
    with_(
        SQL_WASTE, SQL_ERRORS,
        f"""{SQL_ERROR_ROWS}, CAST(trained_at AS TIMESTAMP) AS trained_at, 'spark' AS backend,
            CASE model WHEN 'seasonal_naive' THEN 'total_lag_7d' END AS top_feature FROM errs""",
    ),
)
def metrics_roundtrip(spark, sf):
    """Metrics written as JSON and read back."""
    found = ops.naive_candidates(waste(spark, sf), KEY, "date", "total")
    _, test = split_train_test(found.withColumnRenamed("series", "target"), "date", CUTOFF)
    stamp = test.groupBy("target", "model").agg(F.max("date").alias("trained_at"))
    metrics = ops.holdout_errors(test, ["target", "model"], "date").join(stamp, ["target", "model"])
    top = F.when(F.col("model") == "seasonal_naive", "total_lag_7d")
    metrics = metrics.withColumns({"backend": F.lit("spark"), "top_feature": top})
    path = save_metrics(rounded(metrics), scratch_path(spark, "metrics"))
    return load_metrics(spark, path)


@query(
    "model_champion",
    with_(
        SQL_WASTE, SQL_ERRORS,
        """mc AS (SELECT target, max(mape) FILTER (model = 'seasonal_naive') AS i, max(mape) FILTER (model = 'trailing_mean') AS c
                  FROM errs GROUP BY ALL)""",
        f"""SELECT target, CASE WHEN i > 10 AND c < i THEN 'trailing_mean' ELSE 'seasonal_naive' END AS model,
                   {r('CASE WHEN i > 10 AND c < i THEN c ELSE i END')} AS mape, CAST(i > 10 AS INTEGER) AS challenger_tried FROM mc""",
    ),
)
def model_champion(spark, sf):
    return rounded(ops.choose_champion(holdout_metrics(waste(spark, sf)), ["target"], "seasonal_naive", "trailing_mean"))


@query(
    "model_status",
    with_(
        SQL_WASTE, SQL_ERRORS,
        "known AS (SELECT DISTINCT series AS target, unnest(['seasonal_naive', 'trailing_mean', 'random_forest']) AS model FROM waste)",
        f"""SELECT k.target, k.model, {rs('mape', 'mae', 'rmse')}, test_days,
                   CASE WHEN mape IS NULL THEN 'Not Trained' ELSE 'Active' END AS status,
                   CASE WHEN mape IS NOT NULL THEN printf('MAPE %.2f %%', mape) END AS metric
            FROM known k LEFT JOIN errs e ON e.target = k.target AND e.model = k.model""",
    ),
)
def model_status(spark, sf):
    names = F.array(*[F.lit(n) for n in ("seasonal_naive", "trailing_mean", "random_forest")])
    days = saved(waste(spark, sf).select("series", "date", "total"), "waste")
    known = days.select(F.col("series").alias("target")).distinct()
    known = known.select("target", F.explode(names).alias("model"))
    return rounded(ops.model_status(known, holdout_metrics(days)))
