"""Streaming jobs: any order of files, restarts, equality with the batch result."""

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from meterloom.functions.timeparts import floor_hour
from meterloom.operators.clean import gapfill, interpolate_linear
from meterloom.operators.detect import detect_water
from meterloom.plans import streams
from meterloom.plans.catalog import ORACLES
from meterloom.sources.alert_store import AlertStore
from meterloom.sources.batch_log import BatchLog
from meterloom.sources.files import names_in
from meterloom.streaming import jobs
from tests.compare import compare, duck

SCHEMA = "series string, ts timestamp_ntz, value double"
SF = "/root/testdata/sf0.01"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def t(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def rolled(spark, target):
    rows = jobs.read_rollup(spark, target, ["series"], "ts", ["value"]).collect()
    return {(r.series, r.ts): (r.value_sum, r.value_mean, r.rows) for r in rows}


def test_rollup_restarts_and_keeps_late_rows(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    run = lambda: jobs.hourly_rollup(stream(spark, source), ["series"], "ts", ["value"], target, checkpoint)
    put(spark, source, "1", [("a", t(9, 0, 5), 1.0), ("a", t(9, 0, 50), 2.0), ("a", t(9, 1, 10), None)])
    run()
    assert rolled(spark, target) == {("a", t(9, 0)): (3.0, 1.5, 2), ("a", t(9, 1)): (None, None, 1)}
    put(spark, source, "2", [("a", t(9, 1, 30), 8.0), ("a", t(1, 9), 16.0)])
    run()
    run()
    expected = {("a", t(9, 0)): (3.0, 1.5, 2), ("a", t(9, 1)): (8.0, 8.0, 2), ("a", t(1, 9)): (16.0, 16.0, 1)}
    assert rolled(spark, target) == expected
    jobs.compact_rollup(spark, target, f"{target}-one", ["series"], "ts", ["value"])
    assert rolled(spark, f"{target}-one") == expected


def test_first_per_bucket_over_files(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put(spark, source, "1", [("a", t(5, 0, 5), 1.0), ("a", t(5, 0, 6), 1.0)])
    put(spark, source, "2", [("a", t(5, 0, 50), 2.0), ("b", t(5, 0, 50), 2.0), ("a", t(1, 1), 1.0)])
    put(spark, source, "3", [("a", t(1, 1, 9), 2.0), (None, t(1, 1, 9), 2.0)])
    put(spark, source, "4", [(None, t(1, 1, 19), 2.0)])
    jobs.first_per_bucket(stream(spark, source), ["series"], "ts", target, checkpoint)
    rows = [(r.series, r.bucket) for r in jobs.read_buckets(spark, target).collect()]
    assert len(rows) == 4 and set(rows) == {("a", t(5, 0)), ("a", t(1, 1)), ("b", t(5, 0)), (None, t(1, 1))}


def test_scan_appends_only_new_alerts(spark, tmp_path):
    source, history, checkpoint = (str(tmp_path / n) for n in ("in", "history", "cp"))
    store = AlertStore(spark, str(tmp_path / "store"))
    calm = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 10.0 + h % 3) for h in range(100)]
    put(spark, source, "1", [*calm, ("a", t(5, 4), 200.0)])

    def run(at):
        jobs.scan_into_store(
            stream(spark, source), ["series"], "ts", ["value"], {"flow": F.col("value_sum")},
            lambda hours: detect_water(hours, ["series"], "ts", {"flow": "flow"}, None),
            history, store, checkpoint, F.lit(at).cast("timestamp_ntz"), "water",
        )

    run("2024-02-01")
    assert [(r.ts, r.severity) for r in store.alerts().filter("severity = 'critical'").collect()] == [(t(5, 4), "critical")]
    n = store.alerts().count()
    run("2024-02-01")
    assert store.alerts().count() == n
    put(spark, source, "2", [("a", t(5, 5), 300.0)])
    run("2024-02-01")
    assert sorted(r.ts for r in store.alerts().filter("sigma > 3").collect()) == [t(5, 4), t(5, 5)]
    put(spark, source, "3", [("a", t(5, 6), 900.0)])
    run("2024-01-05 06:30:00")  # the hour isn't closed
    assert store.alerts().filter("ts = timestamp_ntz'2024-01-05 06:00:00'").count() == 0
    run("2024-01-05 07:00:00")  # now it is, and it was not forgotten
    assert store.alerts().filter("ts = timestamp_ntz'2024-01-05 06:00:00'").count() == 1


def batch_alerts(spark, rows):
    hours = spark.createDataFrame(rows, SCHEMA).groupBy("series", floor_hour("ts").alias("ts")).agg(F.sum("value").alias("flow"))
    cleaned = interpolate_linear(gapfill(hours, ["series"], "ts").drop("is_observed"), ["series"], "ts", ["flow"])
    found = detect_water(cleaned, ["series"], "ts", {"flow": "flow"}, None)
    return {(r.alert_id, r.ts, r.actual, r.predicted, r.sigma, r.severity) for r in found.collect()}


def test_scans_of_any_split_equal_one_scan(spark, tmp_path):
    """Gaps, flat stretches longer than a frame, readings before the first, half-filled hours, late days; acknowledgements stay."""
    rng = random.Random(7)
    rows = []
    for series, hours in (("a", 900), ("b", 60), (None, 300)):
        for h in range(hours):
            if series == "a" and 200 <= h < 620:  # stands still for more than two weeks, with gaps
                rows += [(series, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m), 5.0) for m in (1, 31) if h % 7]
            elif rng.random() < 0.8:
                for _ in range(rng.randrange(1, 4)):
                    big = 60.0 if rng.random() < 0.04 else 0.0
                    at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=rng.randrange(60))
                    rows.append((series, at, float(rng.randrange(8, 14)) + big))
    source, history, checkpoint = (str(tmp_path / n) for n in ("in", "history", "cp"))
    store = AlertStore(spark, str(tmp_path / "store"))
    chunks = [[], [], [], []]
    for r in rows:  # first a late stretch, then random parts; the first day of "a" comes last
        early = r[0] == "a" and r[1] < dt.datetime(2024, 1, 2)
        chunks[3 if early else 0 if r[1] > dt.datetime(2024, 1, 20) and rng.random() < 0.7 else rng.choice([1, 2])].append(r)
    acknowledged = set()
    for k, chunk in enumerate(chunks):
        put(spark, source, str(k), chunk)
        jobs.scan_into_store(
            stream(spark, source), ["series"], "ts", ["value"], {"flow": F.col("value_sum")},
            lambda hours: detect_water(hours, ["series"], "ts", {"flow": "flow"}, None),
            history, store, checkpoint, F.lit("2024-03-01").cast("timestamp_ntz"), "water", fanout=2,
        )
        seen = [r for c in chunks[: k + 1] for r in c]
        found = {(r.alert_id, r.ts, r.actual, r.predicted, r.sigma, r.severity) for r in store.alerts().collect()}
        assert found == batch_alerts(spark, seen), k
        if k == 1:
            chosen = store.alerts().filter("severity = 'critical'").select("alert_id", F.lit("2024-03-01").cast("timestamp_ntz").alias("at"))
            acknowledged = {r.alert_id for r in chosen.collect()}
            store.acknowledge(chosen)
    state = {r.alert_id: r.status for r in store.state().collect()}
    kept = acknowledged & set(state)
    assert kept and all(state[i] == "acknowledged" for i in kept)
    assert all(v == "active" for i, v in state.items() if i not in kept)


def test_many_batches_leave_few_folders(spark, tmp_path):
    """A hundred batches; a merge that broke off, and one that lost its inputs, change nothing."""
    log = BatchLog(spark, str(tmp_path / "log"))
    row = lambda k: spark.createDataFrame([(k % 5, k)], "key int, n int")
    fold = lambda df: df.groupBy("key").agg(F.sum("n").cast("int").alias("n"))
    for k in range(40):
        assert log.append(row(k), k)
        assert not log.append(row(99), k)  # a repeated batch adds nothing
        if k == 22:
            with pytest.raises(ZeroDivisionError):
                log.merge(lambda df: 1 / 0, 3)
            log._write(fold(log.read()), "1-0000000020-0000000023")  # written, not published
        else:
            log.merge(fold, 4)
    live = log.manifest().batches
    assert len(live) <= 3 * 3
    assert {r.key: r.n for r in fold(log.read()).collect()} == {i: sum(range(i, 40, 5)) for i in range(5)}
    assert len(names_in(spark, f"{log.root}/data")) <= len(live) + 4 + 1
    assert len(names_in(spark, f"{log.root}/manifest")) <= 3


def test_two_writers_at_once(spark, tmp_path):
    """Both publish; who comes second goes on from the other's version. A reader between sees whole batches."""
    log = BatchLog(spark, str(tmp_path / "log"))
    row = spark.createDataFrame([(1,)], "n int")
    changes = []

    def first(now):
        if not changes:  # another batch is published between reading the version and writing the next
            changes.append(True)
            log.append(row)
        return replace(now, batches=(*now.batches, ("other", 0)))

    assert log.publish(first)
    assert [n == "other" for n, _ in log.manifest().batches] == [False, True]
    assert log.manifest().version == 2
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: log.append(row), range(6)))
    assert len(log.manifest().batches) == 8


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """The same readings as a folder of eight files, not ordered by time."""
    root = str(tmp_path_factory.mktemp("parted"))
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(8, F.xxhash64("event_id")).write.parquet(f"{root}/events.parquet")
    return root


@pytest.mark.parametrize("name", ["stream_rollup_hourly", "stream_alert_dedup", "stream_scan_alerts"])
@pytest.mark.parametrize("max_files", [1, 100])
def test_many_files_equal_batch(spark, parted, name, max_files):
    query = lambda s, sf: getattr(streams, name)(s, sf, max_files)
    same, found, expected, diff, names = compare(spark, duck(SF), parted, query, ORACLES[name])
    assert same, names
    assert found == expected, diff
