"""Cleaning and rollup on hand-made edges, against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meterloom.operators import clean, rollup

HOUR = "series string, ts timestamp_ntz, v double"


def hours(spark, rows):
    parsed = [(k, pd.Timestamp(t).to_pydatetime(), v) for k, t, v in rows]
    return spark.createDataFrame(parsed, HOUR)


def values(df, col="v"):
    return [r[col] for r in df.orderBy("series", "ts").collect()]


def test_gapfill_ranges_are_per_series_and_idempotent(spark):
    df = hours(spark, [("a", "2024-01-01 00:00", 1.0), ("a", "2024-01-01 03:00", 4.0), ("b", "2024-01-01 02:00", 9.0)])
    once = clean.gapfill(df, ["series"], "ts")
    assert values(once) == [1.0, None, None, 4.0, 9.0]
    again = clean.gapfill(once.drop("is_observed"), ["series"], "ts")
    assert values(again) == values(once)
    assert again.filter("not is_observed").count() == 0


def test_gapfill_crosses_a_clock_change_without_a_jump(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = hours(spark, [("a", "2024-03-10 00:00", 1.0), ("a", "2024-03-10 05:00", 2.0)])
        assert clean.gapfill(df, ["series"], "ts").count() == 6
        raw = hours(spark, [("a", "2024-03-10 02:30", 1.0), ("a", "2024-03-10 03:10", 2.0)])
        slots = rollup.rollup(raw, ["series"], "ts", "hour", {"v": "v"})
        assert sorted(r.ts.hour for r in slots.collect()) == [2, 3]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_interpolation_matches_pandas(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(100, 20, 200)
    v[rng.random(200) < 0.3] = np.nan
    v[:3] = np.nan
    v[-4:] = np.nan
    stamps = pd.date_range("2024-01-01", periods=200, freq="h")
    rows = [("a", t, None if np.isnan(x) else float(x)) for t, x in zip(stamps, v)]
    got = values(clean.interpolate_linear(hours(spark, rows), ["series"], "ts", ["v"]))
    want = pd.Series(v).interpolate(method="linear").bfill().ffill()
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_all_null_series_stays_null(spark):
    df = hours(spark, [("a", "2024-01-01 00:00", None), ("a", "2024-01-01 01:00", None)])
    assert values(clean.interpolate_linear(df, ["series"], "ts", ["v"])) == [None, None]
    assert values(clean.fill_forward_back(df, ["series"], "ts", ["v"])) == [None, None]


def test_fill_forward_back(spark):
    rows = [("a", f"2024-01-01 0{i}:00", v) for i, v in enumerate([None, 2.0, None, 5.0, None])]
    assert values(clean.fill_forward_back(hours(spark, rows), ["series"], "ts", ["v"])) == [2.0, 2.0, 2.0, 5.0, 5.0]


def test_dedupe_keeps_the_series_of_one_hour(spark):
    rows = [("a", "2024-01-01 00:00", 2.0), ("a", "2024-01-01 00:00", 1.0), ("a", "2024-01-01 00:00", 1.0), ("b", "2024-01-01 00:00", 7.0)]
    assert values(clean.dedupe_keyed(hours(spark, rows), ["series"], "ts")) == [1.0, 7.0]


def test_resample_sums_nothing_to_zero_and_means_nothing_to_null(spark):
    rows = [("a", "2024-01-01 00:10", None), ("a", "2024-01-01 02:10", 3.0), ("a", "2024-01-01 02:50", 5.0)]
    out = rollup.resample(hours(spark, rows), ["series"], "ts", "hour", {"s": "v"}, {"m": "v"}).orderBy("ts").collect()
    assert [(r.s, r.m) for r in out] == [(0.0, None), (0.0, None), (8.0, 4.0)]


def test_total_daily_adds_members_before_filling(spark):
    df = spark.sql(
        """select * from values ('c', date'2024-01-01', 'van', 5d), ('c', date'2024-01-02', 'bus', null),
           ('c', date'2024-01-04', 'van', 2d), ('c', date'2024-01-04', 'bus', 3d) as t(site, date, vehicle, fuel)"""
    )
    out = clean.total_daily(df, ["site"], "date", ["fuel"]).orderBy("date").collect()
    assert [r.fuel for r in out] == [5.0, 5.0, 5.0, 5.0]


def test_median_comes_from_the_training_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, None), ("a", 4, 100.0)], "series string, d int, v double")
    out = clean.impute_median(df, df.filter("d <= 2"), ["series"], ["v"]).orderBy("d")
    assert [r.v for r in out.collect()] == [1.0, 3.0, 2.0, 100.0]


def test_split_is_inclusive(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-05')) as d")
    train, test = clean.split_train_test(df, "d", "2024-01-03")
    assert (train.count(), test.count()) == (3, 2)
    assert test.agg(F.min("d")).first()[0].day == 4
