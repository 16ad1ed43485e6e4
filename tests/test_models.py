"""Learned forecasters on small series with a known pattern."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.operators import features, forecast, models
from meterloom.operators.clean import split_train_test
from meterloom.sources.artifacts import load_model, save_model

PATTERN = {"a": [10, 20, 30, 40, 50, 60, 70], "b": [5, 9, 2, 8, 1, 7, 3]}


@pytest.fixture(scope="module")
def weekly(spark):
    days = spark.sql("select explode(sequence(date'2023-01-01', date'2024-06-30')) as date")
    both = days.withColumn("series", F.explode(F.array(F.lit("a"), F.lit("b"))))
    level = F.coalesce(
        *[F.when(F.col("series") == k, F.element_at(F.array(*[F.lit(float(x)) for x in v]), F.weekday("date") + 1)) for k, v in PATTERN.items()]
    )
    return both.withColumns({"total": level, "recycled": level / 2, "population": F.lit(100.0)}).cache()


def wanted(row):
    return PATTERN[row.series][row.date.weekday()]


def test_autoregression_continues_the_cycle(weekly, tmp_path, spark):
    model, fitted = models.fit_autoregression(weekly, ["series"], "date", "total")
    models.save_autoregression(fitted, model, str(tmp_path / "ar"))
    again = models.load_autoregression(spark, str(tmp_path / "ar"))
    assert models.load_autoregression(spark, str(tmp_path / "none")) is None
    rows = models.forecast_autoregression(again, weekly, ["series"], "date", "total", 14).collect()
    assert len(rows) == 28
    for r in rows:
        assert abs(r.forecast - wanted(r)) < 0.5 and r.lower <= r.forecast <= r.upper


def test_autoregression_equals_a_plain_loop(weekly):
    model, _ = models.fit_autoregression(weekly, ["series"], "date", "total")
    values = [r.total for r in weekly.filter("series = 'b'").orderBy("date").collect()]
    path = [(v - 1) / 8 for v in values[-14:]]
    for _ in range(10):
        path.append(model.intercept + float(np.dot(model.coefficients, path[-14:])))
    out = models.forecast_autoregression(model, weekly, ["series"], "date", "total", 10)
    got = [r.forecast for r in out.filter("series = 'b'").orderBy("date").collect()]
    np.testing.assert_allclose(got, [max(0, p * 8 + 1) for p in path[14:]])


def test_backcast_echoes_the_first_days(weekly):
    model, _ = models.fit_autoregression(weekly, ["series"], "date", "total")
    rows = models.backcast_autoregression(model, weekly, ["series"], "date", "total").orderBy("series", "idx").collect()
    assert len(rows) == weekly.count()
    assert all(r.predicted == r.actual for r in rows if r.idx < 14)
    assert max(abs(r.predicted - r.actual) for r in rows if r.idx < 60) < 1.0


def test_backcast_of_a_series_shorter_than_the_window(weekly):
    model, _ = models.fit_autoregression(weekly, ["series"], "date", "total")
    short = weekly.filter("date <= date'2023-01-10'")
    rows = models.backcast_autoregression(model, short, ["series"], "date", "total").collect()
    assert len(rows) == 20 and all(r.predicted == r.actual for r in rows)


def test_seasonal_regression_beats_the_flat_forecast(weekly):
    df = weekly.withColumn("is_weekend", (F.weekday("date") >= 5).cast("int"))
    train, test = split_train_test(df, "date", "2024-04-30")
    ahead = models.seasonal_regression(train, test, ["series"], "date", "total", ["population", "is_weekend"])
    both = ahead.join(test.withColumnRenamed("total", "actual"), ["series", "date"]).withColumn("predicted", F.col("forecast"))
    mape = {r.series: r.mape for r in forecast.holdout_errors(both, ["series"], "date").collect()}
    assert set(mape) == {"a", "b"} and max(mape.values()) < 10
    assert all(r.lower <= r.forecast <= r.upper for r in ahead.collect())


@pytest.fixture(scope="module")
def forest(weekly):
    rows = features.waste_features(weekly, ["series"], "date", "total", "recycled", leak_free=True)
    inputs = models.forest_features("total", "population")
    return models.fit_forest(rows, "total", inputs, trees=20, depth=6), rows, inputs


def test_forest_saved_and_loaded_predicts_the_same(forest, spark, tmp_path):
    model, rows, inputs = forest
    again = load_model(spark, save_model(model, str(tmp_path / "rf")))
    both = models.predict_forest(model, rows, inputs).select("series", "date", "predicted").join(
        models.predict_forest(again, rows, inputs).select("series", "date", F.col("predicted").alias("p2")), ["series", "date"]
    )
    assert both.filter("predicted <> p2").count() == 0
    assert models.predict_forest(None, rows, inputs).filter("predicted is not null").count() == 0
    weights = models.forest_importances(spark, model, inputs)
    assert abs(weights.agg(F.sum("importance")).first()[0] - 1) < 1e-9


@pytest.mark.parametrize("seed_lags", [False, True])
def test_forest_recursion_equals_a_plain_loop(forest, spark, seed_lags):
    model, rows, inputs = forest
    steps = 9
    got = models.forecast_forest(model, rows, ["series"], "date", "total", "population", steps, seed_lags)
    got = [r.forecast for r in got.filter("series = 'a'").orderBy("date").collect()]
    hist = [r.total for r in rows.filter("series = 'a'").orderBy(F.desc("date")).limit(7).collect()][::-1]
    preds, last = [], rows.agg(F.max("date")).first()[0]
    for i in range(steps):
        if seed_lags:
            lag7 = preds[i - 7] if i >= 7 else hist[0]
            week = hist if i == 0 else preds[-7:]
        else:
            lag7, week = (hist + preds)[-7], (hist + preds)[-7:]
        day = np.datetime64(last) + i + 1
        dow = (day.astype("datetime64[D]").view("int64") + 3) % 7
        month = int(str(day)[5:7])
        row = {
            "month": month, "day_of_week": int(dow), "is_weekend": int(dow >= 5),
            "is_school_session": int(month in (1, 2, 3, 4, 5, 9, 10, 11, 12)), "quarter": (month + 2) // 3, "population": 100.0,
            "total_lag_1d": (hist + preds)[-1], "total_lag_7d": lag7, "total_rolling_mean_7d": sum(week) / len(week),
        }
        one = spark.createDataFrame([{k: float(v) for k, v in row.items()}])
        preds.append(models.predict_forest(model, one, inputs).first().predicted)
    np.testing.assert_allclose(got, preds)


def test_seasonal_regression_gives_wanted_days_only(weekly):
    """A history day without a value is no forecast, and an unknown series has none."""
    gap = weekly.withColumn("total", F.when(F.col("date") != F.lit("2024-01-20").cast("date"), F.col("total")))
    future = weekly.filter("date >= date'2024-06-28'").select("series", F.date_add("date", 3).alias("date"), "population")
    more = future.unionByName(future.withColumn("series", F.lit("new")))
    rows = models.seasonal_regression(gap, more, ["series"], "date", "total", ["population"]).collect()
    assert len(rows) == 12 and min(r.date for r in rows).isoformat() == "2024-07-01"
    assert {r.series for r in rows if r.forecast is None} == {"new"}
    plan = models.seasonal_regression(gap, future, ["series"], "date", "total", ["population"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_seasonal_weights_equal_least_squares(weekly):
    noisy = weekly.withColumn("total", F.col("total") + F.sin(F.unix_date("date") * 1.7) * 4).withColumn("population", F.unix_date("date") % 13)
    row = models.fit_seasonal(noisy, ["series"], "date", "total", ["population"]).filter("series = 'a'").first()
    data = noisy.filter("series = 'a'").orderBy("date").toPandas()
    day = (np.array(data.date, dtype="datetime64[D]").astype(int)).astype(float)
    parts = [np.ones_like(day), (day - day[0]) / (day[-1] - day[0])]
    for period, order in ((7.0, 3), (365.25, 10)):
        for k in range(1, order + 1):
            parts += [np.sin(2 * np.pi * k / period * day), np.cos(2 * np.pi * k / period * day)]
    p = data.population.astype(float)
    x, y = np.column_stack([*parts, (p - p.mean()) / p.std()]), data.total.to_numpy(float)
    ridge = 1e-3 * len(y) * np.eye(x.shape[1])
    ridge[0, 0] = 0
    weights = np.linalg.solve(x.T @ x + ridge, x.T @ y)
    np.testing.assert_allclose(row.weights, weights, rtol=1e-6, atol=1e-7)
    assert abs(row.width - 1.2816 * np.std(y - x @ weights)) < 1e-6


def test_seasonal_model_saved_and_loaded(weekly, spark, tmp_path):
    model = models.fit_seasonal(weekly, ["series"], "date", "total", ["population"])
    again = models.load_seasonal(spark, models.save_seasonal(model, str(tmp_path / "seasonal")))
    assert sorted(r.series for r in again.collect()) == ["a", "b"]
    assert models.load_seasonal(spark, str(tmp_path / "none")) is None


def test_short_and_unseen_series_get_the_flat_forecast(weekly, forest):
    forest_model, rows, _ = forest
    short = weekly.filter("date >= date'2024-06-26'").withColumn("series", F.concat(F.lit("short_"), "series"))
    unseen = weekly.filter("series = 'a'").withColumn("series", F.lit("unseen"))
    df = weekly.unionByName(short).unionByName(unseen)
    model, _ = models.fit_autoregression(weekly, ["series"], "date", "total")
    for out, name, long in (
        (models.forecast_autoregression(model, df, ["series"], "date", "total", 60), "autoregression", 3),
        (models.forecast_forest(forest_model, df, ["series"], "date", "total", "population", 3), "random_forest", 3),
    ):
        got = {r.series: r.method for r in out.collect()}
        assert len(got) == 5 and sum(m == name for m in got.values()) == long
        assert got["short_a"] == got["short_b"] == "rolling_mean"
    assert models.forecast_autoregression(model, df, ["series"], "date", "total", 60).count() == 300
