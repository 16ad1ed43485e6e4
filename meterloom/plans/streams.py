"""Streaming jobs run to the end of the shared tables, next to their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.operators import detect
from meterloom.plans.alerting import WATER_ROLES, now, sql_water
from meterloom.plans.base import KEY, SQL_HOURLY, SQL_OBSERVED, query, rounded, rs, series_of, table, with_
from meterloom.session import scratch_path
from meterloom.sources.alert_store import AlertStore
from meterloom.streaming import jobs

MAX_FILES = 100


def keyed_stream(events):
    return events.select(
        series_of("event_type").alias("series"), "ts", "value", F.col("user_id").cast("double").alias("level")
    )


def reading_stream(spark, sf, max_files=MAX_FILES):
    schema = table(spark, sf, "events").schema
    return keyed_stream(jobs.read_readings(spark, f"{sf}/events.parquet", schema, max_files))


@query("stream_rollup_hourly", with_(SQL_OBSERVED, f"SELECT series, ts, {rs('usage', 'level', 'readings')} FROM obs"))
def stream_rollup_hourly(spark, sf, max_files=MAX_FILES):
    root = scratch_path(spark, "stream-rollup")
    cols = ["value", "level"]
    jobs.hourly_rollup(reading_stream(spark, sf, max_files), KEY, "ts", cols, f"{root}/hours", f"{root}/checkpoint")
    hours = jobs.read_rollup(spark, f"{root}/hours", KEY, "ts", cols)
    return rounded(
        hours.select(
            "series", "ts", F.col("value_sum").alias("usage"), F.col("level_mean").alias("level"),
            F.col("rows").cast("double").alias("readings"),
        )
    )


@query("stream_alert_dedup", "SELECT DISTINCT coalesce(event_type, 'unknown') AS series, date_trunc('hour', ts) AS bucket FROM events")
def stream_alert_dedup(spark, sf, max_files=MAX_FILES):
    root = scratch_path(spark, "stream-dedup")
    jobs.first_per_bucket(reading_stream(spark, sf, max_files), KEY, "ts", f"{root}/keys", f"{root}/checkpoint")
    return jobs.read_buckets(spark, f"{root}/keys")


SQL_SCANNED = with_(SQL_HOURLY, sql_water(None), "SELECT alert_id, series, ts, metric, severity, sigma, 'active' AS status FROM water_alerts")


def scanned_store(spark, runs, root):
    """The alert store after a run of the water scan over each stream of readings, all with one history."""
    store = AlertStore(spark, f"{root}/store")
    measures = {"water_gallons": F.col("value_sum"), "pressure_psi": F.col("level_mean")}

    def detector(hours):
        return detect.detect_water(hours, KEY, "ts", WATER_ROLES, None)

    for stream in runs:
        jobs.scan_into_store(
            stream(), KEY, "ts", ["value", "level"], measures, detector, f"{root}/history", store, f"{root}/checkpoint", now(), "water",
        )
    return store


@query("stream_scan_alerts", SQL_SCANNED)
def stream_scan_alerts(spark, sf, max_files=MAX_FILES):
    """The water detector over all hours that the stream brought, run twice on the same input."""
    store = scanned_store(spark, [lambda: reading_stream(spark, sf, max_files)] * 2, scratch_path(spark, "stream-scan"))
    return store.state().select("alert_id", "series", "ts", "metric", "severity", "sigma", "status")


@query("stream_scan_parts", SQL_SCANNED)
def stream_scan_parts(spark, sf, parts=3):
    """The readings come in three parts, dealt by their id, with a scan after each: every hour is scanned
    with a third of its readings, with two, and with all, and the alerts are those of one scan of all."""
    root = scratch_path(spark, "stream-parts")
    events = table(spark, sf, "events")
    schema = events.schema

    def after(part):
        def stream():
            own = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == part)
            own.write.mode("append").parquet(f"{root}/events.parquet")
            return keyed_stream(jobs.read_readings(spark, f"{root}/events.parquet", schema, MAX_FILES))

        return stream

    store = scanned_store(spark, [after(p) for p in range(parts)], root)
    return store.state().select("alert_id", "series", "ts", "metric", "severity", "sigma", "status")
