"""KPI edges: months across years, zero totals, missing factors, grades."""

import math

import pytest
from pyspark.sql import functions as F

from meterloom.functions import numeric, severity, text
from meterloom.operators import emissions, forecast, kpi, recent


def days(spark, rows, cols="series string, date string, v double"):
    return spark.createDataFrame(rows, cols).withColumn("date", F.to_date("date"))


def test_month_to_date_keeps_years_apart(spark):
    df = days(spark, [("a", "2023-01-05", 1.0), ("a", "2024-01-03", 2.0), ("a", "2024-01-04", 4.0)])
    assert recent.month_to_date(df, ["series"], "date").agg(F.sum("v")).first()[0] == 6.0


def test_safe_ratio_of_zero_total(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(numeric.safe_ratio("a", "b")).collect()] == [0.0, 0.25]


def test_optional_compost_counts_as_diverted(spark):
    df = spark.sql("select 'a' as series, date'2024-01-02' as date, 4000d as t, 1000d as rec, 600d as composted_lbs")
    row = kpi.diversion_mtd(df, ["series"], "date", "t", "rec").first()
    assert (row.waste_mtd_tons, row.diversion_pct) == (2, 40)
    row = kpi.diversion_mtd(df.drop("composted_lbs"), ["series"], "date", "t", "rec").first()
    assert row.diversion_pct == 25


def test_missing_factor_takes_the_default(spark):
    df = spark.sql("select 'a' as site, 100d as kwh, 1000d as gal, 10d as rec")
    measures = {"Electricity": "kwh", "Water": "gal", "Waste_Recycled": "rec"}
    out = emissions.co2e_by_resource(df, ["site"], measures, emissions.factor_table(spark, without=["Water"]))
    kg = {r.resource_type: r.co2e_kg for r in out.collect()}
    assert kg == {"Electricity": 43.0, "Water": 0.95, "Waste_Recycled": -5.0}
    assert math.isclose(emissions.co2e_total(out, ["site"]).first().co2e_total_kg, 38.95)


def test_grades_and_gauge(spark):
    df = spark.createDataFrame([(90.0,), (80.0,), (74.9,), (60.0,), (49.9,)], "s double")
    rows = df.select(kpi.grade("s"), kpi.gauge_colour("s")).collect()
    assert [r[0] for r in rows] == ["A", "B+", "B", "C+", "C"]
    assert [r[1] for r in rows] == ["#28A745", "#28A745", "#FFC107", "#FFC107", "#DC3545"]


def test_tiers_are_inclusive(spark):
    df = spark.createDataFrame([(3.0,), (2.0,), (1.5,), (1.49,)], "s double")
    assert [r[0] for r in df.select(severity.severity_tier("s")).collect()] == ["critical", "high", "medium", None]


def test_mape_leaves_out_zero_actuals(spark):
    df = spark.createDataFrame([("m", 1, 0.0, 5.0), ("m", 2, 10.0, 8.0)], "model string, d int, actual double, predicted double")
    row = forecast.holdout_errors(df, ["model"], "d").first()
    assert (row.mape, row.mae, row.test_days) == (20.0, 3.5, 2)


def test_champion_rules(spark):
    df = spark.createDataFrame(
        [("a", "x", 9.0), ("a", "y", 1.0), ("b", "x", 18.0), ("b", "y", 12.0), ("c", "x", 18.0), ("c", "y", 20.0)],
        "target string, model string, mape double",
    )
    chosen = {r.target: r.model for r in forecast.choose_champion(df, ["target"], "x", "y").collect()}
    assert chosen == {"a": "x", "b": "y", "c": "x"}


def test_relative_age(spark):
    df = spark.sql(
        """select timestamp_ntz'2024-01-03 00:00:00' as now, ts from values (timestamp_ntz'2024-01-02 23:59:00'),
           (timestamp_ntz'2024-01-02 23:55:00'), (timestamp_ntz'2024-01-02 20:59:00'), (timestamp_ntz'2024-01-01 00:00:00') as t(ts)"""
    )
    assert [r[0] for r in df.select(text.relative_age("ts", "now")).collect()] == ["just now", "5m ago", "3h ago", "2d ago"]


def test_horizon_is_as_asked_for(spark):
    with pytest.raises(ValueError):
        forecast.check_horizon(0)
    df = spark.sql("select 'a' as series, explode(sequence(date'2024-01-01', date'2024-03-01')) as date, 1.0 as v")
    assert forecast.forecast_flat(df, ["series"], "date", "v", 60, 0.1).count() == 60
    assert forecast.future_calendar(df, ["series"], "date", 90).count() == 90


def test_score_over_the_parts_there_are(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-03-30')) as date").withColumns(
        {"series": F.lit("long"), "e": F.lit(10.0), "w": F.lit(5.0)}
    )
    short = days.filter("date < date'2024-01-11'").withColumn("series", F.lit("short"))
    waste = days.select("series", "date", F.lit(0.5).alias("d")).unionByName(short.select("series", "date", F.lit(0.8).alias("d")))
    rows = {r.series: r for r in kpi.sustainability_score(days.unionByName(short), waste, ["series"], "date", "e", "w", "d").collect()}
    assert (rows["long"].energy_score, rows["long"].basis_days, rows["long"].score) == (75, 60, pytest.approx(67.5))
    assert (rows["short"].energy_score, rows["short"].basis_days, rows["short"].score) == (None, 10, pytest.approx(80.0))
    none = kpi.sustainability_score(short, waste.filter("series = 'long'"), ["series"], "date", "e", "w", "d").first()
    assert none.score is None and none.grade is None


def test_forecasts_have_ordered_bounds(spark):
    df = spark.sql("select 'a' as series, explode(sequence(date'2024-01-01', date'2024-03-01')) as date").withColumn(
        "v", 100.0 + F.weekday("date") * 10
    )
    for out in (
        forecast.forecast_flat(df, ["series"], "date", "v", 9, 0.1),
        forecast.forecast_seasonal_rolling(df, ["series"], "date", "v", 9),
    ):
        rows = out.collect()
        assert len(rows) == 9 and all(r.lower <= r.forecast <= r.upper for r in rows)
    seasonal = forecast.forecast_seasonal_rolling(df, ["series"], "date", "v", 9).collect()
    assert all(r.forecast == 100.0 + r.date.weekday() * 10 for r in seasonal)


def test_profile_sums_to_one_and_missing_day_predicts_actual(spark):
    df = spark.sql("select 'a' as series, explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-02 23:00', interval 1 hour)) as ts")
    df = df.withColumn("v", 1.0 + F.hour("ts"))
    profile = forecast.hourly_profile(df, ["series"], "ts", "v")
    assert math.isclose(profile.agg(F.sum("fraction")).first()[0], 1.0)
    yhat = spark.sql("select 'a' as series, date'2024-01-02' as date, 600d as yhat")
    rows = forecast.disaggregate_hourly(df, yhat, profile, ["series"], "ts", "v").orderBy("ts").collect()
    assert all(r.predicted == r.actual for r in rows[:24])
    assert math.isclose(sum(r.predicted for r in rows[24:]), 600.0)
    shared = forecast.disaggregate_hourly(df, yhat, profile, ["series"], "ts", "v", share_missing=True)
    assert shared.orderBy("ts").first().predicted < 1.0
