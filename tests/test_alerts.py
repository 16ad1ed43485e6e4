"""Alert store: de-duplication, state guards, retention."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from meterloom.functions.severity import alert_id, dedup_key
from meterloom.operators import alerts as ops
from meterloom.operators.detect import ALERT_COLUMNS
from meterloom.sources.alert_store import AlertStore


def alert_rows(spark, rows):
    """(series, hour, resource, severity, sigma)"""
    df = spark.createDataFrame(rows, "series string, ts string, resource string, severity string, sigma double")
    df = df.withColumns(
        {
            "ts": F.col("ts").cast("timestamp_ntz"), "metric": F.lit("m"), "actual": F.lit(3.0), "predicted": F.lit(1.0),
            "residual": F.lit(1234.6), "alert_type": F.lit("phantom_load"), "method": F.lit("x"),
        }
    )
    return df.withColumn("alert_id", alert_id(dedup_key("resource", "metric", "series", "ts"))).select(*ALERT_COLUMNS)


ROWS = [
    ("a", "2024-01-01 00:00", "energy", "high", 2.5),
    ("a", "2024-01-01 01:00", "energy", "critical", 3.5),
    ("b", "2024-01-01 01:00", "water", "medium", 1.6),
]


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.fixture
def store(spark, tmp_path):
    s = AlertStore(spark, str(tmp_path / "store"))
    s.add(alert_rows(spark, ROWS), at("2024-01-02 00:00"))
    return s


def status(store):
    return sorted((r.series, r.ts.hour, r.status) for r in store.state().collect())


def ask(store, which, time):
    return store.alerts().filter(which).select("alert_id", at(time).alias("at"))


def test_rescan_adds_nothing(store, spark):
    store.add(alert_rows(spark, ROWS + ROWS), at("2024-01-03 00:00"))
    assert store.alerts().count() == 3
    assert store.alerts("water").count() == 1


def test_repeats_inside_one_batch_fold(spark, tmp_path):
    s = AlertStore(spark, str(tmp_path / "s"))
    s.add(alert_rows(spark, ROWS + ROWS[:1]), at("2024-01-02 00:00"))
    assert s.alerts().count() == 3


def test_state_guards(store):
    store.acknowledge(ask(store, "series = 'b'", "2024-01-02 01:00"))
    store.resolve(ask(store, "hour(ts) = 0 or series = 'b'", "2024-01-02 02:00"))
    store.resolve(ask(store, "hour(ts) = 0", "2024-01-02 03:00"))
    store.acknowledge(ask(store, "hour(ts) = 0", "2024-01-02 04:00"))
    assert status(store) == [("a", 0, "resolved"), ("a", 1, "active"), ("b", 1, "resolved")]
    assert store.events().count() == 3
    assert {r.resolved_at.hour for r in store.state().filter("status = 'resolved'").collect()} == {2}


def test_closed_bucket_alerts_again_unless_told(store, spark):
    store.resolve(ask(store, "true", "2024-01-02 02:00"))
    found = alert_rows(spark, ROWS)
    assert ops.new_only(found, store.state()).count() == 3
    assert ops.new_only(found, store.state(), include_closed=True).count() == 0


def test_purge_drops_old_closed_alerts_only(store, tmp_path):
    store.resolve(ask(store, "series = 'b'", "2024-01-02 02:00"))
    kept, removed = store.purge_to(str(tmp_path / "kept"), at("2024-03-01 00:00"), 30)
    assert removed == 1 and kept.alerts().count() == 2 and store.alerts().count() == 3
    assert kept.state().filter("status = 'active'").count() == 2


def test_order_counts_and_text(store):
    state = store.state()
    assert [r.severity for r in ops.top_active(state, 2).collect()] == ["critical", "high"]
    assert {r.severity: r.alert_count for r in ops.counts(state).collect()} == {"critical": 1, "high": 1, "medium": 1}
    line = ops.dashboard_text(ops.top_active(state, 1)).first()
    assert (line.issue, line.details) == ("Phantom Load", "+1,235 kWh  (3.5σ deviation)")
    buckets = ops.by_bucket(state, 50).orderBy("bucket_order").collect()
    assert [b.severity for b in buckets] == ["critical", "high", "medium"]


def test_buckets_count_all_and_list_some(spark, tmp_path):
    s = AlertStore(spark, str(tmp_path / "s"))
    many = [(f"s{i}", "2024-01-01 00:00", "energy", "high", 2.0 + i / 100) for i in range(9)]
    s.add(alert_rows(spark, many), at("2024-01-02 00:00"))
    row = ops.by_bucket(s.state(), 3).first()
    assert row.alert_count == 9 and len(row.alert_ids.split(",")) == 3


def test_repeats_keep_the_largest_sigma(spark):
    twice = [("a", "2024-01-01 00:00", "energy", "high", x) for x in (2.1, 2.9, 2.5)]
    found = alert_rows(spark, twice)
    assert [r.sigma for r in ops.new_only(found, found.limit(0).withColumn("status", F.lit("active"))).collect()] == [2.9]


def test_a_resource_and_a_day_read_their_folders(store):
    plan = store.alerts("water", at("2024-01-01 00:00"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "resource" in plan.split("PartitionFilters")[1][:200]


def test_recent_uses_real_time(store):
    assert ops.recent(store.state(), at("2024-01-02 23:00"), 24).count() == 3
    assert ops.recent(store.state(), at("2024-01-03 00:01"), 24).count() == 0


def test_two_scans_at_once_leave_each_key_once(spark, tmp_path):
    s = AlertStore(spark, str(tmp_path / "s"))
    more = [*ROWS[1:], ("c", "2024-01-01 05:00", "waste", "high", 2.1)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda rows: s.add(alert_rows(spark, rows), at("2024-01-02 00:00")), [ROWS, more]))
    assert sorted((r.series, r.ts.hour) for r in s.alerts().collect()) == [("a", 0), ("a", 1), ("b", 1), ("c", 5)]


def test_what_was_not_published_is_not_read(store, spark):
    """A scan that broke off after writing its rows, before they were published."""
    rows = store._alerts.read().withColumn("alert_id", F.concat(F.lit("x"), "alert_id"))
    store._alerts._write(rows, "broken")
    assert store.alerts().count() == 3


def covered(spark, lo, hi, series="a"):
    rows = spark.createDataFrame([(series, lo, hi)], "series string, lo string, hi string")
    return rows.select("series", F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi"))


def test_a_scan_replaces_what_was_said_of_its_hours(store, spark):
    store.acknowledge(ask(store, "series = 'a' and hour(ts) = 0", "2024-01-02 01:00"))
    found = alert_rows(spark, [("a", "2024-01-01 00:00", "energy", "critical", 3.1), ("a", "2024-01-01 02:00", "energy", "high", 2.2)])
    hours = covered(spark, "2024-01-01 00:00", "2024-01-01 03:00")
    for _ in range(2):  # the second time nothing is new
        store.rescan(found, hours, "energy", at("2024-01-03 00:00"))
        rows = {(r.series, r.ts.hour): (r.sigma, r.status, r.created_at.day) for r in store.state().collect()}
        assert rows == {("a", 0): (3.1, "acknowledged", 2), ("a", 2): (2.2, "active", 3), ("b", 1): (1.6, "active", 2)}
    assert len(store._alerts.manifest().batches) == 2
    # The withdrawn one is found again: a version after its withdrawal.
    store.rescan(alert_rows(spark, ROWS[:2]), hours, "energy", at("2024-01-04 00:00"))
    assert {(r.series, r.ts.hour): r.sigma for r in store.alerts().collect()} == {("a", 0): 2.5, ("a", 1): 3.5, ("b", 1): 1.6}
    assert store.alerts("water").count() == 1


def test_a_closed_alert_comes_again_as_a_new_one(store, spark):
    store.resolve(ask(store, "series = 'a'", "2024-01-02 02:00"))
    store.add(alert_rows(spark, ROWS), at("2024-01-03 00:00"))
    assert status(store) == [("a", 0, "active"), ("a", 0, "resolved"), ("a", 1, "active"), ("a", 1, "resolved"), ("b", 1, "active")]
    store.add(alert_rows(spark, ROWS), at("2024-01-04 00:00"))
    assert store.alerts().count() == 5


def test_many_scans_leave_few_batches(spark, tmp_path):
    s = AlertStore(spark, str(tmp_path / "s"))
    for day in range(1, 11):
        s.add(alert_rows(spark, [("a", f"2024-01-{day:02d} 00:00", "energy", "high", 2.0 + day)]), at(f"2024-01-{day:02d} 01:00"))
        s.acknowledge(ask(s, f"day(ts) = {day}", f"2024-01-{day:02d} 02:00"))
    assert len(s._alerts.manifest().batches) == len(s._events.manifest().batches) == 3
    state = s.state().collect()
    assert len(state) == 10 and {r.status for r in state} == {"acknowledged"}


def test_recent_alerts_read_their_months_only(spark, tmp_path):
    s = AlertStore(spark, str(tmp_path / "s"))
    s.add(alert_rows(spark, [("a", f"2024-0{m}-05 00:00", "energy", "high", 2.0) for m in range(1, 7)]), at("2024-06-05 06:00"))
    s.add(alert_rows(spark, [("b", "2023-01-05 00:00", "energy", "high", 2.0)]), at("2024-06-05 07:00"))  # of long ago, created now
    found = s.recent(at("2024-06-05 08:00"), 24)
    assert found.count() == 7
    plan = s.alerts(since=at("2024-06-04 08:00"))._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "month" in filters and "2024-06" in filters
