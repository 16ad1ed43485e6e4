"""Alert queries and lifecycle over append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterloom.functions.severity import SEVERITY_ORDER, dedup_key, severity_rank
from meterloom.functions.text import alert_label, decimal_text, resource_unit, signed, title_words, whole_number

# Alert states.
ACTIVE, ACKNOWLEDGED, RESOLVED = "active", "acknowledged", "resolved"


def with_defaults(alerts: DataFrame, created_at: Column) -> DataFrame:
    """Status ``active`` unless given, and the job's time stamp."""
    status = F.col("status") if "status" in alerts.columns else F.lit(None).cast("string")
    return alerts.withColumns(
        {"status": F.coalesce(status, F.lit(ACTIVE)), "created_at": created_at.cast("timestamp_ntz")}
    )


def new_only(found: DataFrame, stored: DataFrame, include_closed: bool = False) -> DataFrame:
    """Found alerts whose key is not stored, each key once.

    Of found alerts with one key the one with the largest sigma is kept.
    Only active alerts suppress a new one, so a closed bucket may alert again;
    ``include_closed=True`` makes every stored alert suppress.
    """
    known = stored if include_closed else stored.filter(F.col("status") == ACTIVE)
    key = dedup_key("resource", "metric", "series", "ts")
    fresh = found.withColumn("_key", key).join(
        known.select(key.alias("_key")), "_key", "left_anti"
    )
    best = F.max_by(F.struct(*found.columns), F.struct("sigma", *[c for c in ("alert_id", "method") if c in found.columns]))
    return fresh.groupBy("_key").agg(best.alias("_a")).select("_a.*")


def current_state(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with the status of their latest event and the time they were resolved."""
    last = events.groupBy("alert_id").agg(
        F.max_by("event", F.struct("at", "event")).alias("_event"),
        F.max(F.when(F.col("event") == RESOLVED, F.col("at"))).alias("resolved_at"),
    )
    joined = alerts.join(last, "alert_id", "left")
    return joined.withColumn("status", F.coalesce("_event", "status", F.lit(ACTIVE))).drop("_event")


def _accepted(alerts: DataFrame, events: DataFrame, requests: DataFrame, allowed: Sequence[str], event: str) -> DataFrame:
    once = requests.groupBy("alert_id").agg(F.min("at").alias("at"))
    state = current_state(alerts, events).filter(F.col("status").isin(*allowed)).select("alert_id")
    return once.join(state, "alert_id", "left_semi").select("alert_id", F.lit(event).alias("event"), "at")


def resolve(alerts: DataFrame, events: DataFrame, requests: DataFrame) -> DataFrame:
    """Events for the requests (alert_id, at) on alerts not yet resolved."""
    return _accepted(alerts, events, requests, [ACTIVE, ACKNOWLEDGED], RESOLVED)


def acknowledge(alerts: DataFrame, events: DataFrame, requests: DataFrame) -> DataFrame:
    """Events for the requests (alert_id, at) on active alerts."""
    return _accepted(alerts, events, requests, [ACTIVE], ACKNOWLEDGED)


def retained(state: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Without closed alerts created more than ``days`` before ``now``."""
    old = F.col("created_at") < now - F.expr(f"interval {days} days")
    return state.filter(~(F.col("status").isin(RESOLVED, ACKNOWLEDGED) & old))


def active(state: DataFrame, resource: str | None = None) -> DataFrame:
    rows = state.filter(F.col("status") == ACTIVE)
    return rows.filter(F.col("resource") == resource) if resource else rows


def top_active(state: DataFrame, limit: int = 50, resource: str | None = None) -> DataFrame:
    """The most severe active alerts, largest sigma first."""
    order = [severity_rank("severity"), F.desc("sigma"), F.col("alert_id")]
    return active(state, resource).orderBy(*order).limit(limit)


def recent(state: DataFrame, now: Column, hours: int = 24, limit: int = 100) -> DataFrame:
    """Alerts created in the last hours, newest first."""
    rows = state.filter(F.col("created_at") >= now - F.expr(f"interval {hours} hours"))
    return rows.orderBy(F.desc("created_at"), "alert_id").limit(limit)


def counts(state: DataFrame) -> DataFrame:
    return active(state).groupBy("severity").agg(F.count(F.lit(1)).alias("alert_count"))


def by_bucket(state: DataFrame, listed: int = 50) -> DataFrame:
    """Active alerts grouped by severity: the count of all, and the ids of the first ``listed`` of each.

    The ids are trimmed by rank in the map tasks before they are collected.
    """
    rows = active(state).select(
        F.coalesce("severity", F.lit(SEVERITY_ORDER[-1])).alias("severity"), (-F.col("sigma")).alias("neg_sigma"), "alert_id"
    )
    rank = F.row_number().over(Window.partitionBy("severity").orderBy("neg_sigma", "alert_id"))
    top = rows.withColumn("_rank", rank).filter(F.col("_rank") <= listed)
    entries = F.sort_array(F.collect_list(F.struct("neg_sigma", "alert_id")))
    ids = top.groupBy("severity").agg(F.array_join(F.transform(entries, lambda e: e["alert_id"]), ",").alias("alert_ids"))
    sizes = rows.groupBy("severity").agg(F.count(F.lit(1)).alias("alert_count"))
    return sizes.join(ids, "severity").withColumn("bucket_order", severity_rank("severity"))


def dashboard_text(top: DataFrame) -> DataFrame:
    """Location, issue and details lines of listed alerts."""
    amount = signed("residual", whole_number("residual"))
    return top.select(
        "alert_id",
        "severity",
        F.coalesce(F.col("series"), title_words("resource")).alias("location"),
        alert_label("alert_type").alias("issue"),
        F.concat(
            amount, F.lit(" "), resource_unit("resource"), F.lit("  ("), decimal_text("sigma", 1), F.lit("σ deviation)")
        ).alias("details"),
    )


def scan_summary(new: DataFrame, state: DataFrame) -> DataFrame:
    """One row: new alerts per resource, active ones per severity."""
    both = new.select("resource", F.lit(None).cast("string").alias("severity"), F.lit(True).alias("is_new"))
    both = both.unionByName(active(state).select("resource", "severity", F.lit(False).alias("is_new")))
    fresh = F.col("is_new")
    return both.agg(
        F.count_if(fresh).alias("new_alerts"),
        *[F.count_if(fresh & (F.col("resource") == r)).alias(f"{r}_new") for r in ("energy", "water", "waste")],
        *[F.count_if(~fresh & (F.col("severity") == s)).alias(f"active_{s}") for s in SEVERITY_ORDER[:3]],
        F.count_if(~fresh).alias("active_total"),
    )


def merge_into_chart(chart: DataFrame, outliers: DataFrame, alerts: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Chart anomalies plus stored alerts on chart days that have none.

    ``chart``: keys, date, idx. ``outliers``: keys, date, idx, type, severity. Of
    several alerts on one day the most severe is kept.
    """
    by = [*keys, date]
    day = alerts.withColumn(date, F.to_date("ts"))
    first = F.min(F.struct(severity_rank("severity").alias("rank"), (-F.col("sigma")).alias("neg_sigma"), "alert_id", "alert_type", "severity"))
    best = day.groupBy(*by).agg(first.alias("_a"))
    added = (
        best.join(outliers.select(*by), by, "left_anti")
        .join(chart.select(*by, "idx"), by)
        .select(*by, "idx", title_words(F.col("_a.alert_type")).alias("type"), F.col("_a.severity").alias("severity"), F.lit("alert").alias("origin"))
    )
    return outliers.select(*by, "idx", "type", "severity", F.lit("chart").alias("origin")).unionByName(added)
