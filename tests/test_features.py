"""Lags, rolling statistics and time blocks against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom.functions.timeparts import hour_number
from meterloom.operators import detect, features
from meterloom.operators.windows import in_time_blocks

N = 480


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    stamps = pd.date_range("2024-01-01", periods=N, freq="h")
    return pd.DataFrame({"series": "a", "ts": stamps, "v": rng.gamma(3, 40, N)})


@pytest.fixture(scope="module")
def frame(spark, series):
    rows = [(s, t.to_pydatetime(), float(v)) for s, t, v in series.itertuples(index=False)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("series", "ts").select(name).collect()]


def test_hourly_lags(frame, series):
    out = frame.withColumns(features.hourly_lag_columns(["series"], "ts", "v"))
    day = series.v.rolling(24, min_periods=1).mean()
    for n in (1, 24, 168):
        np.testing.assert_allclose(column(out, f"v_lag_{n}h"), series.v.shift(n).fillna(day))
    np.testing.assert_allclose(column(out, "v_rolling_mean_3h"), series.v.rolling(3, min_periods=1).mean())


def test_leak_free_mean_leaves_out_the_row(frame, series):
    out = frame.withColumns(features.daily_lag_columns(["series"], "ts", "v", leak_free=True))
    want = series.v.rolling(7, min_periods=1).mean().shift(1)
    got = column(out, "v_rolling_mean_7d")
    assert got[0] is None
    np.testing.assert_allclose(got[1:], want[1:])


@pytest.mark.parametrize("rows", [3, 7])
def test_centered_mean(frame, series, rows):
    got = column(frame.withColumn("s", features.smooth(["series"], "ts", "v", rows)), "s")
    np.testing.assert_allclose(got, series.v.rolling(rows, center=True, min_periods=1).mean())


def test_rolling_std_with_minimum_count_and_backfill(frame, series):
    out = features.rolling_stats(frame, ["series"], "ts", "v", 168, 12, "v_mean", "v_std")
    filled = features.backfill_std(out, ["series"], "ts", "v_std", series_col="v")
    np.testing.assert_allclose(column(filled, "v_std"), series.v.rolling(168, min_periods=12).std().bfill())


@pytest.mark.parametrize("rows, known", [(11, False), (12, True)])
def test_short_series_falls_back_to_its_own_std(frame, rows, known):
    short = frame.filter(hour_number("ts") < hour_number(F.lit("2024-01-01").cast("timestamp_ntz")) + rows)
    out = features.rolling_stats(short, ["series"], "ts", "v", 168, 12, "v_mean", "v_std")
    assert (out.filter("v_std is not null").count() > 0) == known
    assert features.backfill_std(out, ["series"], "ts", "v_std", series_col="v").filter("v_std is null").count() == 0


def test_constant_series_raises_no_alert(spark):
    df = spark.sql("select 'a' as series, explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-05', interval 1 hour)) as ts")
    flat = df.withColumns({"actual": F.lit(5.0), "predicted": F.lit(5.0), "method": F.lit("x")})
    assert detect.detect_energy(flat, ["series"], "ts", "kwh", None).count() == 0


def test_time_blocks_equal_the_unsplit_windows(frame):
    def lagged(df, keys):
        cols = features.hourly_lag_columns(keys, "ts", "v") | {"smooth": features.smooth(keys, "ts", "v", 7)}
        return features.rolling_stats(df.withColumns(cols), keys, "ts", "v", 168, 12, "v_mean", "v_std")

    whole = lagged(frame, ["series"])
    slotted = frame.withColumn("slot", hour_number("ts"))
    blocks = in_time_blocks(slotted, ["series"], "slot", lagged, block=200, before=168, after=3)
    assert blocks.count() == N
    for name in ("v_lag_168h", "v_rolling_mean_24h", "smooth", "v_mean", "v_std"):
        a, b = column(whole, name), column(blocks, name)
        assert [x is None for x in a] == [x is None for x in b]
        np.testing.assert_allclose([x for x in a if x is not None], [x for x in b if x is not None])


def test_lag_vector_has_only_full_windows(frame, series):
    rows = features.lag_vector(frame, ["series"], "ts", "v", 14).orderBy("ts").collect()
    assert len(rows) == N - 14
    np.testing.assert_allclose(rows[0].lags, series.v[:14])


def test_calendar_weekday_and_iso_week(spark):
    df = spark.sql("select timestamp_ntz'2024-12-30 08:00' as ts union all select timestamp_ntz'2024-06-01 18:00'")
    rows = {r.month: r for r in features.add_calendar(df, "ts", True).collect()}
    monday, saturday = rows[12], rows[6]
    assert (monday.day_of_week, monday.week_of_year, monday.is_business_hours, monday.is_school_session) == (0, 1, 1, 1)
    assert (saturday.day_of_week, saturday.is_weekend, saturday.is_business_hours, saturday.is_school_session) == (5, 1, 0, 0)
