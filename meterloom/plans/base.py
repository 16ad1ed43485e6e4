"""Adapters from the shared tables to metered series, with the same relations as SQL.

``events`` give hourly readings keyed by event type, ``lineitem`` daily waste keyed
by line status, ``orders`` daily usage keyed by order status with the priority as
member (building or vehicle type), ``nation``/``supplier`` the sites.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterloom.functions.numeric import tidy
from meterloom.operators.clean import fill_forward_back, gapfill, interpolate_linear
from meterloom.operators.recent import recent_readings
from meterloom.operators.rollup import resample, rollup, with_distinct
from meterloom.session import saved  # noqa: F401  (re-exported to the plans)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEY = ["series"]
MEMBER = ["series", "member"]
CUTOFF = "2001-08-31"  # last training day of the daily tables


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int | Mapping[str, int] = 6) -> DataFrame:
    """Doubles rounded for comparison; other columns as they are."""
    kinds = dict(df.dtypes)
    places = digits if isinstance(digits, Mapping) else {c: digits for c in df.columns}
    return df.select(
        *[tidy(c, places.get(c, 6)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns]
    )


# ---------------------------------------------------------------- adapters


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Series of rows that name none.
NO_SERIES = "unknown"


def series_of(column: str) -> Column:
    """The column as a series key; rows without one are a series of their own."""
    return F.coalesce(column, F.lit(NO_SERIES))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        series_of("event_type").alias("series"),
        "ts",
        "event_id",
        "value",
        F.col("user_id").cast("double").alias("level"),
        F.lit(1.0).alias("reading"),
    )


HOURLY_SUMS = {"usage": "value", "readings": "reading"}
HOURLY_MEANS = {"level": "level"}


def hourly_observed(spark: SparkSession, sf: str) -> DataFrame:
    """series, ts, usage, readings, level for hours that have readings."""
    return rollup(readings(spark, sf), KEY, "ts", "hour", HOURLY_SUMS, HOURLY_MEANS)


def hourly_recent(spark: SparkSession, sf: str, hours: int) -> DataFrame:
    """Continuous hours from ``hours`` before each series' latest on, read from that time on only."""
    near = recent_readings(readings(spark, sf), KEY, "ts", hours)
    grid = gapfill(rollup(near, KEY, "ts", "hour", HOURLY_SUMS, HOURLY_MEANS), KEY, "ts", "hour").drop("is_observed")
    return interpolate_linear(grid, KEY, "ts", ["usage", "readings", "level"])


def hourly_grid(spark: SparkSession, sf: str) -> DataFrame:
    return gapfill(hourly_observed(spark, sf), KEY, "ts", "hour")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous hours, gaps interpolated."""
    grid = hourly_grid(spark, sf).drop("is_observed")
    return interpolate_linear(grid, KEY, "ts", ["usage", "readings", "level"])


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return days_of(hourly(spark, sf))


def days_of(hours: DataFrame) -> DataFrame:
    """series, date, usage, readings, level from the cleaned hours."""
    return rollup(
        hours, KEY, "ts", "day", {"usage": "usage", "readings": "readings"},
        {"level": "level"}, out_ts="date",
    )


def waste_observed(spark: SparkSession, sf: str) -> DataFrame:
    """series, date, total, recycled, landfill, population for days with rows; population is the number of orders."""
    recycled = F.col("l_returnflag") == "R"
    return with_distinct(
        table(spark, sf, "lineitem"),
        {"series": series_of("l_linestatus"), "date": F.to_date("l_shipdate")},
        {
            "total": F.col("l_quantity"),
            "recycled": F.when(recycled, F.col("l_quantity")).otherwise(0.0),
            "landfill": F.when(recycled, 0.0).otherwise(F.col("l_quantity")),
        },
        "l_orderkey",
        "population",
    )


WASTE_VALUES = ["total", "recycled", "landfill", "population"]


def waste(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous days, gaps filled forward then back."""
    grid = gapfill(waste_observed(spark, sf), KEY, "date", "day").drop("is_observed")
    return fill_forward_back(grid, KEY, "date", WASTE_VALUES)


def trips_observed(spark: SparkSession, sf: str) -> DataFrame:
    """series, member, date, fuel, trips, riders for days with orders; riders is the number of customers."""
    return with_distinct(
        table(spark, sf, "orders"),
        {"series": series_of("o_orderstatus"), "member": series_of("o_orderpriority"), "date": F.to_date("o_orderdate")},
        {"fuel": F.col("o_totalprice"), "trips": F.lit(1.0)},
        "o_custkey",
        "riders",
    )


USAGE_VALUES = ["fuel", "trips", "riders"]


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Daily totals over the members of a series; days without any sum to 0."""
    return resample(
        trips_observed(spark, sf), KEY, "date", "day", {c: c for c in USAGE_VALUES}
    )


# ---------------------------------------------------------------- the same in SQL


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of ``tidy``."""
    return f"round({expr} + 1e-{digits + 3}, {digits})"


def rs(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in cols)


def with_(*parts: str) -> str:
    """The last part selects from the CTEs before it."""
    return f"WITH {', '.join(parts[:-1])} {parts[-1]}"


def sql_spine(src: str, out: str, time: str, cols: list[str], step: str, keys: str = "series") -> str:
    """A generated range per key, left-joined to the observed rows."""
    cast = "CAST(u AS DATE)" if step == "DAY" else "u"
    values = ", ".join(f"o.{c}" for c in cols)
    return f"""
{out}_span AS (SELECT {keys}, min({time}) AS lo, max({time}) AS hi FROM {src} GROUP BY ALL),
{out}_days AS (SELECT {keys}, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 {step})) AS u FROM {out}_span),
{out}_spine AS (SELECT {keys}, {cast} AS {time} FROM {out}_days),
{out} AS (SELECT s.*, {values}, (o.{cols[0]} IS NOT NULL) AS is_observed
          FROM {out}_spine s LEFT JOIN {src} o USING ({keys}, {time}))"""


def _half_frames(time: str, keys: str) -> str:
    order = f"PARTITION BY {keys} ORDER BY {time}"
    return (
        f"WINDOW b AS ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"a AS ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )


def sql_interpolate(src: str, out: str, time: str, cols: list[str], keys: str = "series") -> str:
    found = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER b AS pv_{c}, first_value({c} IGNORE NULLS) OVER a AS nv_{c}, "
        f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np_{c}"
        for c in cols
    )
    filled = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pp_{c} IS NOT NULL AND np_{c} IS NOT NULL "
        f"THEN pv_{c} + (nv_{c} - pv_{c}) * (pos - pp_{c}) / (np_{c} - pp_{c}) ELSE coalesce(pv_{c}, nv_{c}) END AS {c}"
        for c in cols
    )
    return f"""
{out}_pos AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {time}) AS pos FROM {src}),
{out}_near AS (SELECT *, {found} FROM {out}_pos {_half_frames(time, keys)}),
{out} AS (SELECT {keys}, {time}, {filled} FROM {out}_near)"""


def sql_fill(src: str, out: str, time: str, cols: list[str], keys: str = "series") -> str:
    filled = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER a) AS {c}"
        for c in cols
    )
    return f"{out} AS (SELECT {keys}, {time}, {filled} FROM {src} {_half_frames(time, keys)})"


HOURLY_COLS = ["usage", "readings", "level"]

SQL_OBSERVED = """
obs AS (SELECT coalesce(event_type, 'unknown') AS series, date_trunc('hour', ts) AS ts, sum(value) AS usage,
               CAST(count(*) AS DOUBLE) AS readings, avg(CAST(user_id AS DOUBLE)) AS level
        FROM events GROUP BY ALL)"""
SQL_GRID = SQL_OBSERVED + "," + sql_spine("obs", "grid", "ts", HOURLY_COLS, "HOUR")
SQL_HOURLY = SQL_GRID + "," + sql_interpolate("grid", "hourly", "ts", HOURLY_COLS)
SQL_DAILY = SQL_HOURLY + """,
daily AS (SELECT series, CAST(ts AS DATE) AS date, sum(usage) AS usage, sum(readings) AS readings,
                 avg(level) AS level FROM hourly GROUP BY ALL)"""

SQL_WASTE_OBSERVED = """
waste_obs AS (SELECT coalesce(l_linestatus, 'unknown') AS series, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS total,
                     sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS recycled,
                     sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS landfill,
                     CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS population
              FROM lineitem GROUP BY ALL)"""
SQL_WASTE_GRID = SQL_WASTE_OBSERVED + "," + sql_spine("waste_obs", "waste_grid", "date", WASTE_VALUES, "DAY")
SQL_WASTE = SQL_WASTE_GRID + "," + sql_fill("waste_grid", "waste", "date", WASTE_VALUES)

SQL_TRIPS = """
trips AS (SELECT coalesce(o_orderstatus, 'unknown') AS series, coalesce(o_orderpriority, 'unknown') AS member, CAST(o_orderdate AS DATE) AS date,
                 sum(o_totalprice) AS fuel, CAST(count(*) AS DOUBLE) AS trips,
                 CAST(count(DISTINCT o_custkey) AS DOUBLE) AS riders
          FROM orders GROUP BY ALL)"""
SQL_USAGE = SQL_TRIPS + """,
usage_obs AS (SELECT series, date, sum(fuel) AS fuel, sum(trips) AS trips, sum(riders) AS riders
              FROM trips GROUP BY ALL),""" + sql_spine("usage_obs", "usage_grid", "date", USAGE_VALUES, "DAY") + """,
usage AS (SELECT series, date, coalesce(fuel, 0) AS fuel, coalesce(trips, 0) AS trips,
                 coalesce(riders, 0) AS riders FROM usage_grid)"""
