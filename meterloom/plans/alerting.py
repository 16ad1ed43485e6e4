"""Detector, alert and alert-lifecycle queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from meterloom.functions import severity, text
from meterloom.operators import alerts as ops, detect
from meterloom.operators.features import rolling_stats, trailing_baseline
from meterloom.operators.forecast import disaggregate_hourly, hourly_profile
from meterloom.operators.recent import tail_per_series, trailing_range
from meterloom.operators.windows import ordered, trailing
from meterloom.plans.base import (
    KEY, SQL_DAILY, SQL_HOURLY, SQL_WASTE, days_of, hourly, hourly_recent, query, rounded, rs, saved, waste, with_,
)
from meterloom.plans.features import frame
from meterloom.plans.forecasts import SQL_AVP, SQL_PREDICTED, chart_hours, day_forecast, predicted_hours
from meterloom.session import scratch_path
from meterloom.sources.alert_store import AlertStore

NOW = "2024-01-31 06:00:00"  # job time of the queries; never read from the clock


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# ---------------------------------------------------------------- detectors

WATER_ROLES = {"water_gallons": "flow", "pressure_psi": "pressure"}


def hours_table(spark, sf):
    """Cleaned hours, rolled up once for every detector."""
    return saved(hourly(spark, sf).select("series", "ts", "usage", "level"), "hours")


def energy_alerts(hours, scan_hours=detect.SCAN_HOURS):
    return detect.detect_energy(predicted_hours(hours), KEY, "ts", "energy_kwh", scan_hours)


def water_alerts(hours, scan_hours=detect.SCAN_HOURS):
    flows = hours.select(
        "series", "ts", F.col("usage").alias("water_gallons"), F.col("level").alias("pressure_psi")
    )
    return detect.detect_water(flows, KEY, "ts", WATER_ROLES, scan_hours)


def waste_alerts(spark, sf, scan_days=detect.SCAN_DAYS):
    week = F.avg("total").over(trailing(KEY, "date", 7))
    rows = waste(spark, sf).select(
        "series", "date", F.col("total").alias("actual"), week.alias("predicted"),
        F.lit("rolling_mean").alias("method"),
    )
    return detect.detect_waste(rows, KEY, "date", "total_waste_lbs", scan_days)


def all_alerts(spark, sf):
    """All three detectors over the whole history."""
    hours = hours_table(spark, sf)
    found = [energy_alerts(hours, None), water_alerts(hours, None), waste_alerts(spark, sf, None)]
    return reduce(DataFrame.unionByName, found)


def stored_alerts(spark, sf):
    return as_stored(all_alerts(spark, sf))


def alert_table(spark, sf):
    """The alert store after a scan of all history; what reads it has no detector in its plan."""
    store = AlertStore(spark, scratch_path(spark, "alert-table"))
    created = F.col("ts") + F.expr("interval 1 hour")
    store.add(as_stored(all_alerts(spark, sf)).drop("created_at"), created)
    return store


def as_stored(found):
    """Found alerts as a table, created an hour after the reading.

    Those of the night are still active, those of the day shift acknowledged, those
    of the late shift resolved.
    """
    hour = F.hour("ts")
    state = F.when(hour < 8, "active").when(hour < 16, "acknowledged").otherwise("resolved")
    created = F.col("ts") + F.expr("interval 1 hour")
    return ops.with_defaults(found.withColumn("status", state), created)


def _after(value: str, t: str) -> str:
    return (
        f"first_value({value} IGNORE NULLS) OVER (PARTITION BY {t} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )


def _sql_std(value: str, rows: int, least: int, t: str, keys: str = "series") -> str:
    f = frame(rows, t, keys)
    return f"CASE WHEN count({value}) {f} >= {least} THEN stddev_samp({value}) {f} END"


def _sql_range(src: str, t: str, span: str | None, keys: str = "series") -> str:
    if span is None:
        return src
    return f"(SELECT * FROM {src} QUALIFY {t} >= max({t}) OVER (PARTITION BY {keys}) - INTERVAL {span})"


def _sql_alerts(name: str, src: str, resource: str, metric: str, t: str, kind: str) -> str:
    bucket = f"strftime(CAST({t} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S')"
    return f"""
{name} AS (SELECT md5(concat_ws('|', '{resource}', {metric}, series, {bucket})) AS alert_id, series,
    CAST({t} AS TIMESTAMP) AS ts, '{resource}' AS resource, {metric} AS metric, {rs('actual', 'predicted', 'residual', 'sigma', digits=2)},
    CASE WHEN sigma >= 3 THEN 'critical' WHEN sigma >= 2 THEN 'high' ELSE 'medium' END AS severity,
    {kind} AS alert_type, method FROM {src} WHERE sigma >= 1.5)"""


def sql_energy(scan: str | None) -> str:
    return f"""
e1 AS (SELECT series, ts, actual, predicted, method, actual - predicted AS residual FROM predicted),
e2 AS (SELECT *, {_sql_std('residual', 168, 12, 'ts')} AS s0 FROM e1),
e3 AS (SELECT *, coalesce({_after('s0', 'series ORDER BY ts')}, stddev_samp(residual) OVER (PARTITION BY series)) AS sd FROM e2),
e4 AS (SELECT *, coalesce(abs(residual) / nullif(sd, 0), 0) AS sigma FROM {_sql_range('e3', 'ts', scan)}),""" + _sql_alerts(
        "energy_alerts", "e4", "energy", "'energy_kwh'", "ts",
        "CASE WHEN residual > 0 THEN 'phantom_load' ELSE 'unusual_drop' END",
    )


def sql_water(scan: str | None) -> str:
    keys = "series, metric"
    mean = f"CASE WHEN count(actual) {frame(168, 'ts', keys)} >= 12 THEN avg(actual) {frame(168, 'ts', keys)} END"
    return f"""
w1 AS (SELECT series, ts, 'water_gallons' AS metric, usage AS actual FROM hourly
       UNION ALL SELECT series, ts, 'pressure_psi', level FROM hourly),
w2 AS (SELECT *, {mean} AS predicted, nullif({_sql_std('actual', 168, 12, 'ts', keys)}, 0) AS s0 FROM w1),
w3 AS (SELECT *, {_after('s0', 'series, metric ORDER BY ts')} AS sd, actual - predicted AS residual, 'rolling_stats' AS method FROM w2),
w4 AS (SELECT *, coalesce(abs(residual) / sd, 0) AS sigma FROM {_sql_range('w3', 'ts', scan, keys)}
       WHERE metric = 'water_gallons' OR residual < 0),""" + _sql_alerts(
        "water_alerts", "w4", "water", "metric", "ts",
        "CASE WHEN metric = 'water_gallons' THEN 'water_spike' ELSE 'pressure_drop' END",
    )


def sql_waste(scan: str | None) -> str:
    return f"""
x1 AS (SELECT series, date, total AS actual, avg(total) {frame(7, 'date')} AS predicted, 'rolling_mean' AS method FROM waste),
x2 AS (SELECT *, nullif({_sql_std('actual', 14, 3, 'date')}, 0) AS s0 FROM x1),
x3 AS (SELECT *, {_after('s0', 'series ORDER BY date')} AS sd, actual - greatest(predicted, 0) AS residual FROM x2),
x4 AS (SELECT *, coalesce(abs(residual) / nullif(coalesce(sd, stddev_samp(actual) OVER (PARTITION BY series)), 0), 0) AS sigma
       FROM {_sql_range('x3', 'date', scan)}),""" + _sql_alerts(
        "waste_alerts", "x4", "waste", "'total_waste_lbs'", "date",
        "CASE WHEN residual > 0 THEN 'waste_spike' ELSE 'waste_drop' END",
    )


SQL_ENERGY_SCAN = with_(SQL_DAILY, SQL_PREDICTED, sql_energy("48 HOUR"), "SELECT * FROM energy_alerts")


@query("detect_energy", SQL_ENERGY_SCAN)
def detect_energy(spark, sf):
    return energy_alerts(hours_table(spark, sf))


@query("detect_energy_recent", SQL_ENERGY_SCAN)
def detect_energy_recent(spark, sf):
    """The same scan with the hourly profile as training leaves it, stored: readings of the range, of the
    week of its frames and of the eight days that the first day's forecast looks back on are all it reads."""
    profile = saved(hourly_profile(hourly(spark, sf).select("series", "ts", "usage"), KEY, "ts", "usage"), "profile")
    near = hourly_recent(spark, sf, detect.SCAN_HOURS + detect.HOURLY_ROWS + 8 * 24)
    hours = saved(near.select("series", "ts", "usage"), "recent-hours")
    predicted = disaggregate_hourly(hours, day_forecast(hours), profile, KEY, "ts", "usage")
    return detect.detect_energy(predicted, KEY, "ts", "energy_kwh")


@query(
    "detect_energy_in_range",
    with_(
        SQL_DAILY, SQL_PREDICTED,
        "recent AS (SELECT * FROM predicted QUALIFY ts >= max(ts) OVER (PARTITION BY series) - INTERVAL 48 HOUR)",
        sql_energy(None).replace("FROM predicted", "FROM recent"),
        "SELECT * FROM energy_alerts",
    ),
)
def detect_energy_in_range(spark, sf):
    """The energy scan with its std taken inside the scan range only."""
    predicted = predicted_hours(hours_table(spark, sf))
    return detect.detect_energy(predicted, KEY, "ts", "energy_kwh", std_after_cut=True)


@query("detect_water", with_(SQL_HOURLY, sql_water("48 HOUR"), "SELECT * FROM water_alerts"))
def detect_water(spark, sf):
    """The last 48 hours, from the readings of those and of the week before them."""
    return water_alerts(hourly_recent(spark, sf, detect.SCAN_HOURS + detect.HOURLY_ROWS))


@query("detect_waste", with_(SQL_WASTE, sql_waste("14 DAY"), "SELECT * FROM waste_alerts"))
def detect_waste(spark, sf):
    return waste_alerts(spark, sf)


SQL_ALL = ", ".join([SQL_DAILY, SQL_WASTE, SQL_PREDICTED, sql_energy(None), sql_water(None), sql_waste(None)]) + """,
found AS (SELECT * FROM energy_alerts UNION ALL SELECT * FROM water_alerts UNION ALL SELECT * FROM waste_alerts)"""
SQL_STORED = SQL_ALL + """,
stored AS (SELECT *, CASE WHEN hour(ts) < 8 THEN 'active' WHEN hour(ts) < 16 THEN 'acknowledged' ELSE 'resolved' END AS status,
                  ts + INTERVAL 1 HOUR AS created_at FROM found)"""
SQL_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"


@query("detect_all", with_(SQL_ALL, "SELECT * FROM found"))
def detect_all(spark, sf):
    return all_alerts(spark, sf)


SQL_TIERS = f"""
t1 AS (SELECT series, ts, usage, CASE WHEN count(usage) {frame(168, 'ts')} >= 12 THEN avg(usage) {frame(168, 'ts')} END AS mean,
              {_sql_std('usage', 168, 12, 'ts')} AS s0 FROM hourly),
t2 AS (SELECT *, coalesce({_after('s0', 'series ORDER BY ts')}, stddev_samp(usage) OVER (PARTITION BY series)) AS sd FROM t1),
t3 AS (SELECT *, coalesce(abs(usage - mean) / nullif(sd, 0), 0) AS sigma FROM t2)"""


@query(
    "severity_tiers",
    with_(
        SQL_HOURLY, SQL_TIERS,
        f"""SELECT series, ts, {rs('usage', 'sigma')},
                   CASE WHEN sigma >= 3 THEN 'critical' WHEN sigma >= 2 THEN 'high' WHEN sigma >= 1.5 THEN 'medium' END AS severity,
                   CASE WHEN usage - mean > 0 THEN 'phantom_load' ELSE 'unusual_drop' END AS alert_type FROM t3""",
    ),
)
def severity_tiers(spark, sf):
    """Raw readings to hours, gaps filled, scored against the rolling week, tiered."""
    from meterloom.operators.features import backfill_std

    rows = hourly(spark, sf).select("series", "ts", "usage")
    rows = rolling_stats(rows, KEY, "ts", "usage", detect.HOURLY_ROWS, detect.HOURLY_MIN, "usage_mean", "usage_std")
    rows = backfill_std(rows, KEY, "ts", "usage_std", series_col="usage")
    residual = F.col("usage") - F.col("usage_mean")
    scored = rows.withColumn("sigma", detect.sigma_of(residual, F.col("usage_std")))
    return rounded(
        scored.select(
            "series", "ts", "usage", "sigma",
            severity.severity_tier("sigma").alias("severity"),
            severity.alert_type(F.lit("energy"), residual).alias("alert_type"),
        )
    )


# ---------------------------------------------------------------- chart anomalies

SQL_CHART_HOURS = """
c1 AS (SELECT * FROM avp QUALIFY ts >= max(ts) OVER (PARTITION BY series) - INTERVAL 168 HOUR),
c2 AS (SELECT *, abs(actual - predicted) AS deviation, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS idx FROM c1),
c3 AS (SELECT *, stddev_samp(deviation) OVER (PARTITION BY series) AS sd FROM c2)"""


@query(
    "residual_2sigma_hourly",
    with_(
        SQL_DAILY, SQL_AVP, SQL_CHART_HOURS,
        f"""SELECT series, ts, CAST(idx AS INTEGER) AS idx, {rs('actual', 'predicted', 'deviation')},
                   CASE WHEN actual > predicted THEN 'Phantom Load' ELSE 'Unusual Drop' END AS type, 'high' AS severity
            FROM c3 WHERE deviation > 2 * sd""",
    ),
)
def residual_2sigma_hourly(spark, sf):
    chart = trailing_range(chart_hours(spark, sf), KEY, "ts", "168 hours")
    found = detect.chart_energy_anomalies(chart, KEY, "ts")
    return rounded(found.drop("method", "deviation_std"))


SQL_CHART_DAYS = f"""
d1 AS (SELECT series, date, usage AS actual FROM daily QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) <= 60),
d2 AS (SELECT *, avg(actual) {frame(8, 'date')} AS predicted, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS idx FROM d1),
d3 AS (SELECT *, abs(actual - predicted) AS deviation FROM d2),
d4 AS (SELECT *, stddev_pop(deviation) OVER (PARTITION BY series) AS sd FROM d3),
day_out AS (SELECT series, date, CAST(idx AS INTEGER) AS idx, actual, predicted, deviation,
                   CASE WHEN actual > predicted THEN 'High Spike' ELSE 'Unusual Drop' END AS type,
                   CASE WHEN deviation / (sd + 1e-9) >= 3 THEN 'critical' WHEN deviation / (sd + 1e-9) >= 2 THEN 'high' ELSE 'medium' END AS severity
            FROM d4 WHERE deviation > 2 * sd)"""


def chart_days(hours):
    """The last 60 days with their trailing baseline."""
    days = tail_per_series(days_of(hours), KEY, "date", 60)
    base = trailing_baseline(KEY, "date", "usage")
    idx = F.row_number().over(ordered(KEY, "date")) - 1
    return days.select("series", "date", idx.alias("idx"), F.col("usage").alias("actual"), base.alias("predicted"))


@query(
    "residual_2sigma_daily",
    with_(SQL_DAILY, SQL_CHART_DAYS, f"SELECT series, date, idx, type, severity, {rs('actual', 'predicted', 'deviation')} FROM day_out"),
)
def residual_2sigma_daily(spark, sf):
    found = detect.chart_water_anomalies(chart_days(hourly(spark, sf)).drop("idx"), KEY, "date")
    return rounded(found.drop("deviation_std"))


@query(
    "chart_alert_merge",
    with_(
        SQL_DAILY, SQL_CHART_DAYS, sql_water(None),
        f"""best AS (SELECT series, CAST(ts AS DATE) AS date, alert_type, severity, row_number() OVER (
                     PARTITION BY series, CAST(ts AS DATE) ORDER BY {SQL_RANK}, sigma DESC, alert_id) AS rn FROM water_alerts)""",
        """SELECT series, date, idx, type, severity, 'chart' AS origin FROM day_out
           UNION ALL
           SELECT b.series, b.date, CAST(d2.idx AS INTEGER), CASE alert_type WHEN 'water_spike' THEN 'Water Spike' ELSE 'Pressure Drop' END,
                  b.severity, 'alert' FROM best b JOIN d2 ON d2.series = b.series AND d2.date = b.date
           WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM day_out o WHERE o.series = b.series AND o.date = b.date)""",
    ),
)
def chart_alert_merge(spark, sf):
    hours = hours_table(spark, sf)
    chart = saved(chart_days(hours.withColumn("readings", F.lit(0.0))), "chart")
    outliers = detect.chart_water_anomalies(chart.drop("idx"), KEY, "date")
    return ops.merge_into_chart(chart, outliers, water_alerts(hours, None), KEY, "date")


# ---------------------------------------------------------------- keys, labels, ages


@query(
    "alert_keys",
    with_(
        SQL_ALL,
        """SELECT alert_id, resource, metric, ts,
                  concat_ws('|', resource, metric, series, strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS dedup_key FROM found""",
    ),
)
def alert_keys(spark, sf):
    key = severity.dedup_key("resource", "metric", "series", "ts").alias("dedup_key")
    return all_alerts(spark, sf).select("alert_id", "resource", "metric", "ts", key)


SQL_LABEL = """CASE alert_type WHEN 'phantom_load' THEN 'Phantom Load' WHEN 'unusual_drop' THEN 'Unusual Drop'
    WHEN 'water_spike' THEN 'Water Spike' WHEN 'pressure_drop' THEN 'Pressure Drop'
    WHEN 'waste_spike' THEN 'Waste Spike' ELSE 'Waste Drop' END"""
SQL_UNIT = "CASE resource WHEN 'energy' THEN 'kWh' WHEN 'water' THEN 'Gal' ELSE 'lbs' END"


@query(
    "alert_labels",
    with_(
        SQL_ALL,
        f"""SELECT alert_id, {SQL_LABEL} AS label, {SQL_UNIT} AS unit,
                   upper(resource[1]) || resource[2:] || ' ' || {SQL_LABEL} AS title FROM found""",
    ),
)
def alert_labels(spark, sf):
    return all_alerts(spark, sf).select(
        "alert_id",
        text.alert_label("alert_type").alias("label"),
        text.resource_unit("resource").alias("unit"),
        F.concat_ws(" ", text.title_words("resource"), text.title_words("alert_type")).alias("title"),
    )


@query(
    "alert_age",
    with_(
        SQL_STORED,
        f"aged AS (SELECT alert_id, floor(epoch(TIMESTAMP '{NOW}' - created_at) / 60)::BIGINT AS m FROM stored)",
        """SELECT alert_id, CASE WHEN m < 2 THEN 'just now' WHEN m < 60 THEN m || 'm ago'
                  WHEN m // 60 < 24 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age FROM aged""",
    ),
)
def alert_age(spark, sf):
    return stored_alerts(spark, sf).select("alert_id", text.relative_age("created_at", now()).alias("age"))


# ---------------------------------------------------------------- alert queries

SQL_COLS = "alert_id, series, ts, resource, metric, actual, predicted, residual, sigma, severity, alert_type, method, status, created_at"


@query(
    "alerts_active",
    with_(SQL_STORED, f"SELECT {SQL_COLS} FROM stored WHERE status = 'active' ORDER BY {SQL_RANK}, sigma DESC, alert_id LIMIT 50"),
)
def alerts_active(spark, sf):
    return ops.top_active(alert_table(spark, sf).state().drop("resolved_at"), 50)


@query(
    "alerts_active_resource",
    with_(SQL_STORED, f"SELECT {SQL_COLS} FROM stored WHERE status = 'active' AND resource = 'water' ORDER BY {SQL_RANK}, sigma DESC, alert_id LIMIT 50"),
)
def alerts_active_resource(spark, sf):
    return ops.top_active(alert_table(spark, sf).state("water").drop("resolved_at"), 50)


@query(
    "alerts_recent",
    with_(SQL_STORED, f"SELECT {SQL_COLS} FROM stored WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR ORDER BY created_at DESC, alert_id LIMIT 100"),
)
def alerts_recent(spark, sf):
    return alert_table(spark, sf).recent(now(), 72, 100).drop("resolved_at")


@query("alert_counts", with_(SQL_STORED, "SELECT severity, count(*) AS alert_count FROM stored WHERE status = 'active' GROUP BY ALL"))
def alert_counts(spark, sf):
    return ops.counts(alert_table(spark, sf).state())


@query(
    "alerts_by_bucket",
    with_(
        SQL_STORED,
        "act AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY sigma DESC, alert_id) AS rn FROM stored WHERE status = 'active')",
        f"""SELECT severity, count(*) AS alert_count, string_agg(alert_id, ',' ORDER BY rn) FILTER (rn <= 50) AS alert_ids,
                   CAST({SQL_RANK} AS INTEGER) AS bucket_order FROM act GROUP BY severity""",
    ),
)
def alerts_by_bucket(spark, sf):
    return ops.by_bucket(alert_table(spark, sf).state(), 50)


@query(
    "alerts_top3",
    with_(
        SQL_STORED,
        f"page AS (SELECT * FROM stored WHERE status = 'active' ORDER BY {SQL_RANK}, sigma DESC, alert_id LIMIT 3)",
        f"""SELECT alert_id, severity, series AS location, {SQL_LABEL} AS issue,
                   CASE WHEN residual > 0 THEN '+' ELSE '' END || format('{{:,}}', CAST(round_even(residual, 0) AS BIGINT)) || ' ' ||
                   {SQL_UNIT} || '  (' || printf('%.1f', sigma) || 'σ deviation)' AS details FROM page""",
    ),
)
def alerts_top3(spark, sf):
    return ops.dashboard_text(ops.top_active(alert_table(spark, sf).state(), 3))


def earlier(found):
    """The part of the alerts that an earlier scan has stored."""
    return as_stored(found).filter(F.col("created_at") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


SQL_KNOWN = "known AS (SELECT * FROM stored WHERE created_at < TIMESTAMP '2024-01-20 00:00:00')"


@query(
    "alert_new_only",
    with_(SQL_STORED, SQL_KNOWN, "SELECT alert_id, resource, severity, ts FROM found WHERE alert_id NOT IN (SELECT alert_id FROM known WHERE status = 'active')"),
)
def alert_new_only(spark, sf):
    """Found alerts without an active one of the same bucket among those stored earlier."""
    found = saved(all_alerts(spark, sf), "found")
    return ops.new_only(found, earlier(found)).select("alert_id", "resource", "severity", "ts")


@query(
    "scan_summary",
    with_(
        SQL_STORED, SQL_KNOWN,
        "fresh AS (SELECT * FROM found WHERE alert_id NOT IN (SELECT alert_id FROM known WHERE status = 'active'))",
        "act AS (SELECT severity FROM known WHERE status = 'active' UNION ALL SELECT severity FROM fresh)",
        """SELECT (SELECT count(*) FROM fresh) AS new_alerts,
                  (SELECT count(*) FROM fresh WHERE resource = 'energy') AS energy_new,
                  (SELECT count(*) FROM fresh WHERE resource = 'water') AS water_new,
                  (SELECT count(*) FROM fresh WHERE resource = 'waste') AS waste_new,
                  count(*) FILTER (severity = 'critical') AS active_critical, count(*) FILTER (severity = 'high') AS active_high,
                  count(*) FILTER (severity = 'medium') AS active_medium, count(*) AS active_total FROM act""",
    ),
)
def scan_summary(spark, sf):
    """A scan on top of stored alerts: what is new, and what is active afterwards."""
    found = saved(all_alerts(spark, sf), "found")
    known = earlier(found)
    fresh = saved(ops.new_only(found, known), "fresh")
    state = known.unionByName(ops.with_defaults(fresh, now()))
    return ops.scan_summary(fresh, state)


# ---------------------------------------------------------------- lifecycle


@query(
    "alert_append",
    with_(SQL_ALL, "SELECT resource, severity, 'active' AS status, count(*) AS alert_count FROM found GROUP BY ALL"),
)
def alert_append(spark, sf):
    """Two appends to an alert store; the second adds only what the first did not have."""
    store = AlertStore(spark, scratch_path(spark, "alerts"))
    found = saved(all_alerts(spark, sf), "found")
    store.add(found.filter("resource = 'energy'"), now())
    store.add(found, now())
    return store.state().groupBy("resource", "severity", "status").agg(F.count(F.lit(1)).alias("alert_count"))


@query(
    "alert_state",
    with_(
        SQL_ALL,
        """SELECT alert_id, CASE WHEN h >= 12 THEN 'resolved' WHEN h >= 8 THEN 'acknowledged' ELSE 'active' END AS status,
                  CASE WHEN h >= 12 THEN ts + INTERVAL 2 HOUR END AS resolved_at FROM (SELECT *, hour(ts) AS h FROM found)""",
    ),
)
def alert_state(spark, sf):
    """Acknowledge, resolve, then requests that the state guards must turn down."""
    store = AlertStore(spark, scratch_path(spark, "alerts"))
    store.add(all_alerts(spark, sf), now())
    stored, hour = store.alerts(), F.hour("ts")

    def requests(which, hours: int):
        at = F.col("ts") + F.expr(f"interval {hours} hours")
        return stored.filter(which).select("alert_id", at.alias("at"))

    store.acknowledge(requests((hour >= 8) & (hour < 16), 1))
    store.resolve(requests(hour >= 12, 2))  # acknowledged and active ones
    store.acknowledge(requests(hour >= 16, 3))  # already resolved
    store.resolve(requests(hour >= 12, 4))  # already resolved
    return store.state().select("alert_id", "status", "resolved_at")


@query(
    "alert_retention",
    with_(
        SQL_STORED,
        f"""SELECT alert_id, status, created_at FROM stored
            WHERE NOT (status IN ('resolved', 'acknowledged') AND created_at < TIMESTAMP '{NOW}' - INTERVAL 10 DAY)""",
    ),
)
def alert_retention(spark, sf):
    return ops.retained(stored_alerts(spark, sf), now(), 10).select("alert_id", "status", "created_at")


@query(
    "alert_purge",
    with_(
        SQL_STORED,
        f"""aged AS (SELECT status IN ('resolved', 'acknowledged') AND created_at < TIMESTAMP '{NOW}' - INTERVAL 10 DAY AS old FROM stored)""",
        "SELECT count(*) FILTER (NOT old) AS kept, count(*) FILTER (old) AS removed FROM aged",
    ),
)
def alert_purge(spark, sf):
    """The store copied without old closed alerts, with the number left out."""
    target, removed = alert_table(spark, sf).purge_to(scratch_path(spark, "purged"), now(), 10)
    return target.alerts().agg(F.count(F.lit(1)).alias("kept"), F.lit(removed).cast("long").alias("removed"))
