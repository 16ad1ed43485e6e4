"""Queries that fit a model; checked by contract (rows, bounds, errors), not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.functions.timeparts import is_school_session, is_weekend
from meterloom.operators import detect, forecast as fc, models
from meterloom.operators.clean import drop_missing_target, split_train_test
from meterloom.operators.features import waste_features
from meterloom.plans.base import CUTOFF, KEY, SQL_WASTE, query, r, rounded, saved, waste, with_
from meterloom.session import scratch_path
from meterloom.sources.artifacts import load_model, save_model

TARGET, POPULATION = "total", "population"
INPUTS = models.forest_features(TARGET, POPULATION)


def forest_table(spark, sf):
    """Daily waste with features; the weekly mean ends the day before (no target leak).

    Saved once: the fit and the scoring both read it.
    """
    days = waste_features(waste(spark, sf), KEY, "date", TARGET, "recycled", leak_free=True)
    return saved(drop_missing_target(days.select("series", "date", TARGET, *INPUTS), TARGET), "forest-rows")


def trained_forest(days):
    train, test = split_train_test(days, "date", CUTOFF)
    return models.fit_forest(train, TARGET, INPUTS), test


@query("waste_rf_holdout")
def waste_rf_holdout(spark, sf):
    """Forest errors on the days after the cutoff, from the saved and reloaded model."""
    fitted, test = trained_forest(forest_table(spark, sf))
    model = load_model(spark, save_model(fitted, scratch_path(spark, "forest")))
    scored = models.predict_forest(model, test, INPUTS).withColumnRenamed(TARGET, "actual")
    errors = fc.holdout_errors(scored.withColumnRenamed("series", "target"), ["target"], "date")
    return rounded(errors.withColumn("model", F.lit("random_forest")))


@query("waste_feature_importance")
def waste_feature_importance(spark, sf):
    fitted, _ = trained_forest(forest_table(spark, sf))
    weights = models.forest_importances(spark, fitted, INPUTS)
    return weights.orderBy(F.desc("importance"), "feature").limit(3)


@query("forecast_waste")
def forecast_waste(spark, sf):
    days = forest_table(spark, sf)
    fitted = models.fit_forest(days, TARGET, INPUTS)
    return rounded(models.forecast_forest(fitted, days, KEY, "date", TARGET, POPULATION, 7))


@query("detect_waste_model")
def detect_waste_model(spark, sf):
    """Waste alerts over all days with the forest as predictor."""
    days = forest_table(spark, sf)
    fitted, _ = trained_forest(days)
    scored = models.predict_forest(fitted, days, INPUTS).select(
        "series", "date", F.col(TARGET).alias("actual"), "predicted", F.lit("random_forest").alias("method")
    )
    return detect.detect_waste(scored, KEY, "date", "total_waste_lbs", None)


@query(
    "waste_prediction_without_model",
    with_(SQL_WASTE, f"SELECT series, date, {r('total')} AS actual, CAST(NULL AS DOUBLE) AS predicted FROM waste"),
)
def waste_prediction_without_model(spark, sf):
    """Before a model is trained a prediction is NULL, on every day there is."""
    none = load_model(spark, scratch_path(spark, "no-model"))
    days = models.predict_forest(none, waste(spark, sf), INPUTS)
    return rounded(days.select("series", "date", F.col(TARGET).alias("actual"), "predicted"))


@query("forecast_ar")
def forecast_ar(spark, sf):
    days = saved(waste(spark, sf).select("series", "date", TARGET), "waste")
    model, _ = models.fit_autoregression(days, KEY, "date", TARGET)
    return rounded(models.forecast_autoregression(model, days, KEY, "date", TARGET, 14))


@query("ar_holdout")
def ar_holdout(spark, sf):
    """Errors of the autoregression run freely over the days after the cutoff."""
    days = saved(waste(spark, sf).select("series", "date", TARGET), "waste")
    train, test = split_train_test(days, "date", CUTOFF)
    model, _ = models.fit_autoregression(train, KEY, "date", TARGET)
    horizon = test.groupBy("date").agg(F.lit(1)).count()
    ahead = models.forecast_autoregression(model, train, KEY, "date", TARGET, horizon)
    both = ahead.select("series", "date", F.col("forecast").alias("predicted")).join(
        test.withColumnRenamed(TARGET, "actual"), ["series", "date"]
    )
    errors = fc.holdout_errors(both.withColumnRenamed("series", "target"), ["target"], "date")
    return rounded(errors.withColumn("model", F.lit("autoregression")))


@query("ar_backcast")
def ar_backcast(spark, sf):
    """In-sample path of every series: 14 actual days, then free-running predictions."""
    days = saved(waste(spark, sf).select("series", "date", TARGET), "waste")
    model, _ = models.fit_autoregression(days, KEY, "date", TARGET)
    return rounded(models.backcast_autoregression(model, days, KEY, "date", TARGET))


REGRESSORS = [POPULATION, "is_weekend", "is_school_session"]


def _regression_table(df):
    return df.withColumns({"is_weekend": is_weekend("date"), "is_school_session": is_school_session("date")})


@query("forecast_seasonal_regression")
def forecast_seasonal_regression(spark, sf):
    days = saved(waste(spark, sf).select("series", "date", TARGET, POPULATION), "waste")
    future = fc.future_regressors(days, KEY, "date", POPULATION, 30)
    return rounded(
        models.seasonal_regression(_regression_table(days), future, KEY, "date", TARGET, REGRESSORS)
    )


@query("seasonal_regression_holdout")
def seasonal_regression_holdout(spark, sf):
    days = saved(_regression_table(waste(spark, sf).select("series", "date", TARGET, POPULATION)), "waste")
    train, test = split_train_test(days, "date", CUTOFF)
    ahead = models.seasonal_regression(train, test, KEY, "date", TARGET, REGRESSORS)
    both = ahead.select("series", "date", F.col("forecast").alias("predicted")).join(
        test.select("series", "date", F.col(TARGET).alias("actual")), ["series", "date"]
    )
    errors = fc.holdout_errors(both.withColumnRenamed("series", "target"), ["target"], "date")
    return rounded(errors.withColumn("model", F.lit("seasonal_regression")))


# ---------------------------------------------------------------- contracts

# A learned number has no SQL, but what must hold for any fit has: the days, the order of
# the bounds, the floor, and an error that is not above that of the flat forecast.


def _kept(forecast):
    """Per series: days, first and last day, and whether the bounds are in order and at zero or above."""
    return forecast.groupBy("series").agg(
        F.count(F.lit(1)).alias("days"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.min((F.col("lower") <= F.col("forecast")) & (F.col("forecast") <= F.col("upper"))).alias("bounds_in_order"),
        F.min(F.col("lower") >= 0).alias("at_least_zero"),
        F.max("method").alias("method"),
    )


def _sql_kept(days: int, method: str) -> str:
    return with_(
        SQL_WASTE,
        f"""SELECT series, {days} AS days, max(date) + 1 AS first_day, max(date) + {days} AS last_day,
                   true AS bounds_in_order, true AS at_least_zero, '{method}' AS method FROM waste GROUP BY series""",
    )


@query("forecast_waste_contract", _sql_kept(7, "random_forest"))
def forecast_waste_contract(spark, sf):
    return _kept(forecast_waste(spark, sf))


@query("forecast_ar_contract", _sql_kept(14, "autoregression"))
def forecast_ar_contract(spark, sf):
    return _kept(forecast_ar(spark, sf))


@query("forecast_seasonal_regression_contract", _sql_kept(30, "seasonal_regression"))
def forecast_seasonal_regression_contract(spark, sf):
    return _kept(forecast_seasonal_regression(spark, sf))


def _against_flat(spark, sf, errors):
    """Per series: test days, and whether the RMSE is at most 1.05 times that of the flat forecast."""
    days = waste(spark, sf).select("series", "date", TARGET)
    train, test = split_train_test(days, "date", CUTOFF)
    level = fc.forecast_flat(train, KEY, "date", TARGET, 1, 0.1).select("series", F.col("forecast").alias("predicted"))
    both = test.withColumnRenamed(TARGET, "actual").join(level, "series").withColumnRenamed("series", "target")
    flat = fc.holdout_errors(both, ["target"], "date").select("target", F.col("rmse").alias("flat_rmse"))
    return errors.join(flat, "target").select(
        F.col("target").alias("series"), "model", "test_days", (F.col("rmse") <= 1.05 * F.col("flat_rmse")).alias("not_above_flat")
    )


def _sql_against_flat(model: str) -> str:
    return with_(
        SQL_WASTE,
        f"""SELECT series, '{model}' AS model, count(DISTINCT date) AS test_days, true AS not_above_flat
            FROM waste WHERE date > DATE '{CUTOFF}' GROUP BY series""",
    )


@query("waste_rf_holdout_contract", _sql_against_flat("random_forest"))
def waste_rf_holdout_contract(spark, sf):
    return _against_flat(spark, sf, waste_rf_holdout(spark, sf))


@query("ar_holdout_contract", _sql_against_flat("autoregression"))
def ar_holdout_contract(spark, sf):
    return _against_flat(spark, sf, ar_holdout(spark, sf))


@query("seasonal_regression_holdout_contract", _sql_against_flat("seasonal_regression"))
def seasonal_regression_holdout_contract(spark, sf):
    return _against_flat(spark, sf, seasonal_regression_holdout(spark, sf))


@query("waste_feature_importance_contract", "SELECT 3 AS features, true AS all_inputs, true AS shares")
def waste_feature_importance_contract(spark, sf):
    top = waste_feature_importance(spark, sf)
    return top.agg(
        F.count_distinct("feature").alias("features"),
        F.min(F.col("feature").isin(*INPUTS)).alias("all_inputs"),
        ((F.min("importance") > 0) & (F.sum("importance") <= 1.0 + 1e-9)).alias("shares"),
    )


# Fixed weights of a small autoregression, newest day last, for the recursion itself.
FIXED_WEIGHTS, FIXED_INTERCEPT = (0.2, 0.0, 0.1, 0.0, 0.0, 0.15, 0.3), 0.05


def _fixed_model(days):
    scale = days.groupBy(*KEY).agg(F.min(TARGET).alias("lo"), F.max(TARGET).alias("hi"))
    return models.Autoregression(FIXED_WEIGHTS, FIXED_INTERCEPT, scale)


SQL_FIXED = f"""
span AS (SELECT series, min(total) AS lo, max(total) AS hi, max(date) AS last_day, stddev_samp(total) AS sd FROM waste GROUP BY series),
numbered AS (SELECT w.series, date, total, lo, hi, (total - lo) / (hi - lo) AS v,
                    row_number() OVER (PARTITION BY w.series ORDER BY date) AS up,
                    row_number() OVER (PARTITION BY w.series ORDER BY date DESC) AS down FROM waste w JOIN span USING (series)),
walk(series, i, vals) AS (
    SELECT series, 0, list(v ORDER BY date) FROM numbered WHERE {{side}} <= 7 GROUP BY series
    UNION ALL
    SELECT series, i + 1, list_append(vals[2:], {FIXED_INTERCEPT}::DOUBLE + list_dot_product(vals, {list(FIXED_WEIGHTS)}::DOUBLE[]))
    FROM walk WHERE i < {{steps}})"""


@query(
    "ar_fixed_forecast",
    "WITH RECURSIVE " + ", ".join([SQL_WASTE, SQL_FIXED.format(side="down", steps=45)]) + f"""
    SELECT series, last_day + i AS date, {r('greatest(0, vals[7] * (hi - lo) + lo)')} AS forecast
    FROM walk JOIN span USING (series) WHERE i > 0""",
)
def ar_fixed_forecast(spark, sf):
    """45 days ahead by fixed weights: the horizon is what was asked for."""
    days = saved(waste(spark, sf).select("series", "date", TARGET), "waste")
    ahead = models.forecast_autoregression(_fixed_model(days), days, KEY, "date", TARGET, 45)
    return rounded(ahead.select("series", "date", "forecast"))


@query(
    "ar_fixed_backcast",
    "WITH RECURSIVE " + ", ".join([SQL_WASTE, SQL_FIXED.format(side="up", steps="(SELECT max(up) - 7 FROM numbered)")]) + f"""
    SELECT n.series, n.date, CAST(n.up - 1 AS INTEGER) AS idx, {r('n.total')} AS actual,
           {r('CASE WHEN n.up <= 7 THEN n.total ELSE greatest(0, w.vals[7] * (n.hi - n.lo) + n.lo) END')} AS predicted
    FROM numbered n LEFT JOIN walk w ON w.series = n.series AND w.i = n.up - 7""",
)
def ar_fixed_backcast(spark, sf):
    """The whole in-sample path by fixed weights."""
    days = saved(waste(spark, sf).select("series", "date", TARGET), "waste")
    return rounded(models.backcast_autoregression(_fixed_model(days), days, KEY, "date", TARGET))
