"""Alert table on parquet: versions of alerts and status events, published batch by batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from meterloom import schemas
from meterloom.functions.severity import alert_id, dedup_key
from meterloom.operators import alerts as ops
from meterloom.session import saved
from meterloom.sources.batch_log import BatchLog

KEY = ("resource", "metric", "series", "ts")
VALUES = ("actual", "predicted", "residual", "sigma", "severity", "alert_type", "method")
NAMES = [f.name for f in schemas.ALERTS.fields]
#: ``scan`` orders the versions of an alert; a withdrawn version takes it out of the table.
STORED = T.StructType([
    *schemas.ALERTS.fields, T.StructField("withdrawn", T.BooleanType()), T.StructField("scan", T.StringType()),
    T.StructField("month", T.StringType()),
])


def _month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


@dataclass(frozen=True)
class AlertStore:
    """``alerts`` is partitioned by resource and month, ``events`` holds status changes.

    A scan publishes its rows as one batch, all or nothing. An alert may have versions in
    several batches; the one of the latest scan counts, so two scans at once that find the
    same alert leave it once. The month is that of the alert's creation, or of its time if
    that is later: every row of an alert keeps it, and neither a time of creation nor a key
    can be in an earlier month than its own. Full levels of batches are merged as scans go
    on: versions to the latest one, events to the last of each kind.
    """

    spark: SparkSession
    root: str

    @property
    def _alerts(self) -> BatchLog:
        return BatchLog(self.spark, f"{self.root}/alerts", ("resource", "month"))

    @property
    def _events(self) -> BatchLog:
        return BatchLog(self.spark, f"{self.root}/events")

    def alerts(self, resource: str | None = None, since: Column | None = None) -> DataFrame:
        """The alerts there are; a resource, and a time to begin with, read their folders only.

        With ``since`` all alerts come that were created then or later, or that are of then or later.
        """
        now = self._alerts.manifest()
        rows = self._alerts.read(manifest=now)
        if rows is None:
            return self.spark.createDataFrame([], schemas.ALERTS)
        if resource:
            rows = rows.filter(F.col("resource") == resource)
        if since is not None:
            rows = rows.filter(F.col("month") >= _month(since))
        if len(now.batches) > 1:  # a batch has an alert once
            rows = _latest(rows)
        return rows.filter(~F.col("withdrawn")).select(*NAMES)

    def events(self) -> DataFrame:
        rows = self._events.read()
        return self.spark.createDataFrame([], schemas.ALERT_EVENTS) if rows is None else rows

    def state(self, resource: str | None = None, since: Column | None = None) -> DataFrame:
        """Alerts with their status; the events are those since the last merge and what it left of earlier ones."""
        rows = self.alerts(resource, since)
        if not self._events.manifest().batches:
            return rows.withColumns({"status": F.coalesce("status", F.lit(ops.ACTIVE)), "resolved_at": F.lit(None).cast("timestamp_ntz")})
        return ops.current_state(rows, self.events())

    def recent(self, now: Column, hours: int = 24, limit: int = 100) -> DataFrame:
        """Alerts created in the last hours, newest first; older months are not read."""
        return ops.recent(self.state(since=now - F.expr(f"interval {hours} hours")), now, hours, limit)

    def add(self, found: DataFrame, created_at: Column, include_closed: bool = False) -> None:
        """Publish the alerts whose key is not stored, or of which all stored ones are closed.

        The earliest time of the found alerts limits the part of the store that is read, so
        the check does not grow with its age. An alert that comes again after it was closed
        is one of its own.
        """
        if not self._alerts.manifest().batches:
            self._append(ops.with_defaults(_once(found), created_at))
            return
        rows = saved(found, "found-alerts")
        since = rows.agg(F.min("ts")).first()[0]
        if since is None:
            return
        near = saved(self.state(since=F.lit(since).cast("timestamp_ntz")), "stored-alerts")
        fresh = ops.with_defaults(ops.new_only(rows, near, include_closed), created_at)
        again = near.select(dedup_key(*KEY).alias("_known")).distinct()
        key = dedup_key(*KEY)
        later = alert_id(F.concat_ws("|", key, F.col("created_at").cast("string")))
        fresh = fresh.join(again, key == F.col("_known"), "left")
        fresh = fresh.withColumn("alert_id", F.when(F.col("_known").isNull(), F.col("alert_id")).otherwise(later))
        self._append(fresh.drop("_known"))

    def rescan(self, found: DataFrame, covered: DataFrame, resource: str, created_at: Column) -> None:
        """What a scan says of the hours it covered, in the place of what earlier scans said of them.

        ``covered``: series, lo, hi; ``found`` has no alerts outside. An alert found again keeps its
        id, status and time of creation and takes the new values; one that is not found any more is
        withdrawn; a new one is added. The same result again publishes nothing.
        """
        ranges = saved(covered.select("series", "lo", "hi"), "covered-hours")
        since = ranges.agg(F.min("lo")).first()[0]
        if since is None:
            return
        key = dedup_key(*KEY)
        stored = self.alerts(resource, F.lit(since).cast("timestamp_ntz")).alias("s")
        inside = F.col("s.ts").between(F.col("c.lo"), F.col("c.hi")) & F.col("s.series").eqNullSafe(F.col("c.series"))
        stored = stored.join(ranges.alias("c"), inside, "left_semi").withColumn("_key", key)
        stored = stored.groupBy("_key").agg(F.max_by(F.struct(*NAMES), F.struct("created_at", "alert_id")).alias("old"))
        fresh = ops.with_defaults(_once(found), created_at).select(key.alias("_key"), F.struct(*NAMES).alias("new"))
        both = stored.join(fresh, "_key", "full")
        changed = F.col("old").isNull() | F.col("new").isNull() | ~F.struct(*[f"old.{v}" for v in VALUES]).eqNullSafe(F.struct(*[f"new.{v}" for v in VALUES]))
        row = {n: F.col(f"new.{n}") if n in VALUES else F.coalesce(f"old.{n}", f"new.{n}") for n in NAMES}
        gone = F.col("new").isNull()
        rows = both.filter(changed).select(
            *[F.when(gone, F.col(f"old.{n}")).otherwise(row[n]).alias(n) for n in NAMES], gone.alias("withdrawn")
        )
        rows = saved(rows, "rescanned-alerts")
        if not rows.isEmpty():
            self._append(rows)

    def _append(self, rows: DataFrame) -> None:
        log = self._alerts
        if "withdrawn" not in rows.columns:
            rows = rows.withColumn("withdrawn", F.lit(False))
        scan = f"{log.manifest().version + 1:010d}"
        log.append(
            rows.select(
                *[F.col(f.name).cast(f.dataType) for f in schemas.ALERTS.fields], "withdrawn", F.lit(scan).alias("scan"),
                _month(F.greatest("created_at", "ts")).alias("month"),
            )
        )
        log.merge(_latest)

    def _change(self, events: DataFrame) -> None:
        log = self._events
        log.append(events.select(*[F.col(f.name).cast(f.dataType) for f in schemas.ALERT_EVENTS.fields]))
        log.merge(lambda e: e.groupBy("alert_id", "event").agg(F.max("at").alias("at")))

    def resolve(self, requests: DataFrame) -> None:
        """``requests``: alert_id, at."""
        self._change(ops.resolve(self.alerts(), self.events(), requests))

    def acknowledge(self, requests: DataFrame) -> None:
        self._change(ops.acknowledge(self.alerts(), self.events(), requests))

    def purge_to(self, root: str, now: Column, days: int = 30) -> tuple[AlertStore, int]:
        """A new store without old closed alerts, and how many those were; the old one is left as it is."""
        state = saved(self.state(), "alert-state")
        kept = saved(ops.retained(state, now, days).select("alert_id"), "kept-alerts")
        target = AlertStore(self.spark, root)
        target._append(self.alerts().join(kept, "alert_id", "left_semi"))
        target._change(self.events().join(kept, "alert_id", "left_semi"))
        return target, state.count() - kept.count()


def _latest(rows: DataFrame) -> DataFrame:
    """The version of each alert that the latest scan left; of one scan's, the larger sigma."""
    rest = [c for c in rows.columns if c not in ("alert_id", "resource", "month")]
    best = F.max_by(F.struct(*rest), F.struct("scan", "sigma", "method"))
    return rows.groupBy("alert_id", "resource", "month").agg(best.alias("_v")).select("alert_id", "resource", "month", "_v.*").select(*rows.columns)


def _once(found: DataFrame) -> DataFrame:
    """Each key once, with the largest sigma."""
    best = F.max_by(F.struct(*found.columns), F.struct("sigma", "method"))
    return found.groupBy(dedup_key(*KEY).alias("_key")).agg(best.alias("_a")).select("_a.*")
