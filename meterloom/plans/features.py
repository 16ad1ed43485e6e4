"""Calendar, lag, rolling and smoothing feature queries."""

from __future__ import annotations

from meterloom.functions.numeric import safe_ratio
from meterloom.functions.timeparts import hour_number
from meterloom.operators import features as ops
from meterloom.operators.clean import total_daily
from meterloom.operators.windows import in_time_blocks, trailing
from meterloom.plans.base import (
    KEY, SQL_DAILY, SQL_HOURLY, SQL_USAGE, SQL_WASTE, USAGE_VALUES, daily, hourly, query, r, rounded, rs,
    sql_fill, trips_observed, waste, with_,
)
from pyspark.sql import functions as F

# Fixed value: school months, as in the calendar functions.
SCHOOL = "(1, 2, 3, 4, 5, 9, 10, 11, 12)"
TS, DATE = "ts", "date"


def sql_calendar(t: str, hourly: bool) -> str:
    weekend = f"isodow({t}) >= 6"
    common = f"""CAST(isodow({t}) - 1 AS INTEGER) AS day_of_week, dayname({t}) AS day_name,
        CAST(month({t}) AS INTEGER) AS month, CAST(weekofyear({t}) AS INTEGER) AS week_of_year,
        CAST({weekend} AS INTEGER) AS is_weekend, CAST(month({t}) IN {SCHOOL} AS INTEGER) AS is_school_session"""
    if hourly:
        return f"""CAST(hour({t}) AS INTEGER) AS hour, {common},
            CAST(hour({t}) >= 8 AND hour({t}) < 18 AND NOT ({weekend}) AS INTEGER) AS is_business_hours"""
    return f"{common}, CAST(quarter({t}) AS INTEGER) AS quarter"


def frame(rows: int, t: str, keys: str = "series") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY {t} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def sql_lags(col: str, t: str, lags: tuple[int, ...], unit: str, fallback: int, means: tuple[int, ...]) -> str:
    o = f"OVER (PARTITION BY series ORDER BY {t})"
    parts = [
        f"{r(f'coalesce(lag({col}, {n}) {o}, avg({col}) {frame(fallback, t)})')} AS {col}_lag_{n}{unit}"
        for n in lags
    ]
    parts += [f"{r(f'avg({col}) {frame(n, t)}')} AS {col}_rolling_mean_{n}{unit}" for n in means]
    return ", ".join(parts)


def sql_smooth(col: str, t: str, half: int) -> str:
    return r(
        f"avg({col}) OVER (PARTITION BY series ORDER BY {t} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    )


SQL_HOURLY_LAGS = sql_lags("usage", "ts", (1, 24, 168), "h", 24, (3, 24))


def sql_daily_lags(col: str) -> str:
    return sql_lags(col, "date", (1, 7), "d", 7, (7,))


@query("calendar_hourly", with_(SQL_HOURLY, f"SELECT series, ts, {sql_calendar('ts', True)} FROM hourly"))
def calendar_hourly(spark, sf):
    return ops.add_calendar(hourly(spark, sf).select("series", "ts"), "ts", hourly=True)


@query("calendar_daily", with_(SQL_WASTE, f"SELECT series, date, {sql_calendar('date', False)} FROM waste"))
def calendar_daily(spark, sf):
    return ops.add_calendar(waste(spark, sf).select("series", "date"), "date", hourly=False)


@query("lags_hourly", with_(SQL_HOURLY, f"SELECT series, ts, {SQL_HOURLY_LAGS} FROM hourly"))
def lags_hourly(spark, sf):
    rows = hourly(spark, sf).select("series", "ts", "usage")
    return rounded(rows.withColumns(ops.hourly_lag_columns(KEY, "ts", "usage")).drop("usage"))


@query("lags_hourly_in_blocks", with_(SQL_HOURLY, f"SELECT series, ts, {SQL_HOURLY_LAGS} FROM hourly"))
def lags_hourly_in_blocks(spark, sf):
    """The same lags with every series cut into two-week blocks that run in parallel."""
    rows = hourly(spark, sf).select("series", "ts", "usage", hour_number("ts").alias("slot"))

    def lags(df, keys):
        return df.withColumns(ops.hourly_lag_columns(keys, "ts", "usage"))

    out = in_time_blocks(rows, KEY, "slot", lags, block=14 * 24, before=168)
    return rounded(out.drop("usage", "slot"))


@query("lags_daily", with_(SQL_WASTE, f"SELECT series, date, {sql_daily_lags('total')} FROM waste"))
def lags_daily(spark, sf):
    rows = waste(spark, sf).select("series", "date", "total")
    return rounded(rows.withColumns(ops.daily_lag_columns(KEY, "date", "total")).drop("total"))


@query(
    "rolling_means",
    with_(
        SQL_HOURLY,
        "SELECT series, ts, "
        + ", ".join(f"{r(f'avg(usage) {frame(n, TS)}')} AS mean_{n}" for n in (3, 7, 24))
        + " FROM hourly",
    ),
)
def rolling_means(spark, sf):
    means = {f"mean_{n}": F.avg("usage").over(trailing(KEY, "ts", n)) for n in (3, 7, 24)}
    return rounded(hourly(spark, sf).select("series", "ts", *[c.alias(n) for n, c in means.items()]))


@query(
    "smooth_centered",
    with_(SQL_HOURLY, f"SELECT series, ts, {sql_smooth('usage', 'ts', 1)} AS smooth_3, {sql_smooth('usage', 'ts', 3)} AS smooth_7 FROM hourly"),
)
def smooth_centered(spark, sf):
    return rounded(
        hourly(spark, sf).select(
            "series",
            "ts",
            ops.smooth(KEY, "ts", "usage", 3).alias("smooth_3"),
            ops.smooth(KEY, "ts", "usage", 7).alias("smooth_7"),
        )
    )


SQL_ROLLING_STATS = f"""
rstat AS (SELECT series, ts, usage,
    CASE WHEN count(usage) {frame(168, 'ts')} >= 12 THEN avg(usage) {frame(168, 'ts')} END AS usage_mean,
    CASE WHEN count(usage) {frame(168, 'ts')} >= 12 THEN stddev_samp(usage) {frame(168, 'ts')} END AS raw_std
  FROM hourly),
rfill AS (SELECT *, coalesce(
    first_value(raw_std IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    stddev_samp(usage) OVER (PARTITION BY series)) AS usage_std FROM rstat)"""


@query(
    "rolling_stats_min_periods",
    with_(SQL_HOURLY, SQL_ROLLING_STATS, f"SELECT series, ts, {rs('usage_mean', 'usage_std')} FROM rfill"),
)
def rolling_stats_min_periods(spark, sf):
    rows = hourly(spark, sf).select("series", "ts", "usage")
    stats = ops.rolling_stats(rows, KEY, "ts", "usage", 168, 12, "usage_mean", "usage_std")
    filled = ops.backfill_std(stats, KEY, "ts", "usage_std", series_col="usage")
    return rounded(filled.drop("usage"))


@query(
    "baseline_trailing",
    with_(SQL_DAILY, f"SELECT series, date, {r(f'avg(usage) {frame(8, DATE)}')} AS baseline FROM daily"),
)
def baseline_trailing(spark, sf):
    rows = daily(spark, sf)
    return rounded(rows.select("series", "date", ops.trailing_baseline(KEY, "date", "usage").alias("baseline")))


@query(
    "lag_vectors",
    with_(
        SQL_WASTE,
        "lv AS (SELECT series, date, "
        + ", ".join(f"lag(total, {15 - i}) OVER o AS lag_{i}" for i in range(1, 15))
        + ", row_number() OVER o AS rn FROM waste WINDOW o AS (PARTITION BY series ORDER BY date))",
        f"SELECT series, date, {rs(*[f'lag_{i}' for i in range(1, 15)])} FROM lv WHERE rn > 14",
    ),
)
def lag_vectors(spark, sf):
    """The 14 values before each day, oldest first."""
    rows = ops.lag_vector(waste(spark, sf).select("series", "date", "total"), KEY, "date", "total", 14)
    return rounded(rows.select("series", "date", *[F.element_at("lags", i).alias(f"lag_{i}") for i in range(1, 15)]))


@query(
    "diversion_daily",
    with_(SQL_WASTE, f"SELECT series, date, {r('coalesce(recycled / nullif(total, 0), 0)')} AS diversion_rate FROM waste"),
)
def diversion_daily(spark, sf):
    return rounded(waste(spark, sf).select("series", "date", safe_ratio("recycled", "total").alias("diversion_rate")))


@query(
    "features_hourly",
    with_(
        SQL_HOURLY,
        f"""SELECT series, ts, {rs('usage', 'level', 'readings')}, {sql_calendar('ts', True)}, {SQL_HOURLY_LAGS},
                   {sql_smooth('usage', 'ts', 1)} AS usage_smoothed FROM hourly""",
    ),
)
def features_hourly(spark, sf):
    return rounded(ops.hourly_features(hourly(spark, sf), KEY, "ts", "usage"))


@query(
    "features_daily",
    with_(
        SQL_DAILY,
        f"""SELECT series, date, {rs('usage', 'level', 'readings')}, {sql_calendar('date', False)},
                   {sql_daily_lags('usage')}, {sql_smooth('usage', 'date', 3)} AS usage_smoothed FROM daily""",
    ),
)
def features_daily(spark, sf):
    return rounded(ops.daily_features(daily(spark, sf), KEY, "date", ["usage"], ["usage"]))


@query(
    "features_waste_daily",
    with_(
        SQL_WASTE,
        f"""SELECT series, date, {rs('total', 'recycled', 'landfill', 'population')}, {sql_calendar('date', False)},
                   {sql_daily_lags('total')}, {sql_daily_lags('recycled')},
                   {sql_smooth('total', 'date', 3)} AS total_smoothed,
                   {r('coalesce(recycled / nullif(total, 0), 0)')} AS diversion_rate FROM waste""",
    ),
)
def features_waste_daily(spark, sf):
    return rounded(ops.waste_features(waste(spark, sf), KEY, "date", "total", "recycled"))


@query(
    "features_transport_daily",
    with_(
        SQL_USAGE,
        sql_fill("usage_grid", "fleet", "date", USAGE_VALUES),
        f"""SELECT series, date, {rs('fuel', digits=2)}, trips, riders, {sql_calendar('date', False)},
                   {sql_lags('trips', 'date', (1, 7), 'd', 7, (7,))} FROM fleet""",
    ),
)
def features_transport_daily(spark, sf):
    """Daily totals over the members, filled, with lags but no smoothing."""
    fleet = total_daily(trips_observed(spark, sf), KEY, "date", USAGE_VALUES)
    return rounded(ops.daily_features(fleet, KEY, "date", ["trips"]), {"fuel": 2})
