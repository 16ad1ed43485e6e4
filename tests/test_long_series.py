"""Long and hot series: frames that don't grow with their length, fills in time blocks, scans of the last hours."""

import datetime as dt
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom.operators import clean, features, models, recent, rollup
from meterloom.plans import alerting, base
from meterloom.plans.catalog import ORACLES, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


def hours(spark, values, series="a"):
    rows = [(series, START + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("series", "ts").select(name).collect()]


# ------------------------------------------------------------ rolling statistics


@pytest.mark.parametrize("rows, least", [(33, 2), (50, 12), (168, 12)])
def test_long_frames_equal_pandas(spark, rows, least):
    """Gaps, a level far from zero, a jump, and lengths around the blocks' ends."""
    rng = np.random.default_rng(rows)
    v = 1e7 + rng.normal(0, 3, 5 * rows + 7)
    v[2 * rows :] += 5e5
    v[rng.random(len(v)) < 0.2] = np.nan
    v[: rows // 4] = np.nan
    s = pd.Series(v)
    out = features.rolling_stats(hours(spark, [None if np.isnan(x) else float(x) for x in v]), ["series"], "ts", "v", rows, least, "m", "s")
    mean, std = (np.array([np.nan if x is None else x for x in column(out, c)]) for c in ("m", "s"))
    frames = [s.iloc[max(0, i - rows + 1) : i + 1].dropna() for i in range(len(s))]
    enough = [len(f) >= least for f in frames]
    np.testing.assert_allclose(mean, [f.mean() if e else np.nan for f, e in zip(frames, enough)], rtol=1e-13)
    np.testing.assert_allclose(std, [f.std() if e else np.nan for f, e in zip(frames, enough)], rtol=1e-8)
    assert out.columns == ["series", "ts", "v", "m", "s"]


def test_frame_of_equal_values_has_no_spread(spark):
    v = [0.1] * 200 + [7.3] + [0.1] * 400 + [None] * 200 + [0.1] * 40
    out = features.rolling_stats(hours(spark, v), ["series"], "ts", "v", 168, 12, "m", "s")
    std = column(out, "s")
    assert set(std[11:200]) == {0.0} and min(std[200:368]) > 0 and set(std[368:600]) == {0.0}
    assert std[780] is None and std[-1] == 0.0
    assert column(out, "m")[500] == pytest.approx(0.1, abs=1e-15)


def test_cost_does_not_grow_with_the_frame(spark):
    """A frame of 4,000 rows costs no more than one of 200; summed anew it would be twenty times."""
    df = spark.range(0, 400_000, 1, 8).select(
        (F.col("id") % 20).cast("string").alias("series"), F.timestamp_add("HOUR", (F.col("id") / 20).cast("int"), F.lit(START)).alias("ts"),
        F.rand(1).alias("v"),
    )
    took = {}
    for rows in (200, 200, 4000):
        begun = time.time()
        features.rolling_stats(df, ["series"], "ts", "v", rows, 12, "m", "s").agg(F.sum("s"), F.sum("m")).collect()
        took[rows] = time.time() - begun
    assert took[4000] < 3 * took[200] + 1


# ------------------------------------------------------------ fills in blocks


@pytest.fixture(scope="module")
def sparse(spark):
    """One series with gaps within blocks, over blocks and over whole empty ones, and a short one."""
    rng = np.random.default_rng(3)
    rows = []
    for series, n, share in (("hot", 3000, 0.3), ("few", 40, 0.5), (None, 200, 0.2)):
        for i in np.flatnonzero(rng.random(n) < share):
            if series == "hot" and 900 < i < 1700:
                continue
            value = None if rng.random() < 0.3 else float(np.round(rng.gamma(2, 50), 3))
            rows.append((series, START + dt.timedelta(hours=int(i)), value, None if rng.random() < 0.9 else float(i)))
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, v double, w double").repartition(4)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_hours", [7, 100, 10_000])
def test_blocks_give_the_same(sparse, block_hours):
    block = block_hours * 3600
    grid = clean.gapfill(sparse, ["series"], "ts")
    assert values(clean.gapfill(sparse, ["series"], "ts", block=block)) == values(grid)
    grid = grid.drop("is_observed")
    for fill in (clean.interpolate_linear, clean.fill_forward_back):
        whole = fill(grid, ["series"], "ts", ["v", "w"])
        assert values(fill(grid, ["series"], "ts", ["v", "w"], block=block)) == values(whole)


def test_one_series_is_the_work_of_many_tasks(spark, sparse):
    one = clean.gapfill(sparse.filter("series = 'hot'"), ["series"], "ts").drop("is_observed")
    tasks = lambda df: df.groupBy(F.spark_partition_id().alias("t")).agg(F.sum("v")).count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tasks(clean.interpolate_linear(one, ["series"], "ts", ["v"])) == 1
        assert tasks(clean.interpolate_linear(one, ["series"], "ts", ["v"], block=240 * 3600)) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ------------------------------------------------------------ backcast


@pytest.mark.parametrize("days", [5, 14, 15, 142, 143, 600])
def test_backcast_in_blocks_equals_the_recursion(spark, days):
    rng = np.random.default_rng(days)
    model_weights, intercept = tuple(map(float, rng.normal(0, 0.15, 14))), 0.2
    rows, expected = [], {}
    for series, n in (("a", days), ("b", max(1, days // 3))):
        x = rng.random(n)
        rows += [(series, dt.date(2023, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
        path = list(x[:14])
        while len(path) < n:
            path.append(intercept + float(np.dot(model_weights, path[-14:])))
        expected |= {(series, i): x[i] if i < 14 else max(0.0, path[i]) for i in range(n)}
    df = spark.createDataFrame(rows, "series string, date date, x double")
    scale = df.select("series").distinct().withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0)})
    model = models.Autoregression(model_weights, intercept, scale)
    got = {(r.series, r.idx): r.predicted for r in models.backcast_autoregression(model, df, ["series"], "date", "x").collect()}
    assert set(got) == set(expected)
    np.testing.assert_allclose([got[k] for k in expected], list(expected.values()), rtol=1e-9, atol=1e-12)


# ------------------------------------------------------------ the last hours


def test_scan_of_the_last_hours_reads_those(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [("a", START + dt.timedelta(hours=h), 1.0) for h in range(0, 1000)] + [("b", START + dt.timedelta(hours=h), 2.0) for h in (3, 700, 990)]
    rows += [(None, START + dt.timedelta(hours=h), 3.0) for h in (980, 999)]
    spark.createDataFrame(rows, "series string, ts timestamp_ntz, v double").coalesce(1).sortWithinPartitions("ts").write.parquet(path)
    near = recent.recent_readings(spark.read.parquet(path), ["series"], "ts", 100)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan
    got = {}
    for r in near.collect():
        got.setdefault(r.series, []).append(int((r.ts - START).total_seconds() // 3600))
    assert min(got["a"]) == 887 and len(got["a"]) == 113  # 100 hours before the latest, and the last of the day before
    assert sorted(got["b"]) == [700, 990]  # the last reading before the range begins
    assert sorted(got[None]) == [980, 999]


def test_recent_hours_equal_the_whole_history(spark):
    found = alerting.water_alerts(base.hourly(spark, SF)).collect()
    assert sorted(map(tuple, QUERIES["detect_water"](spark, SF).collect())) == sorted(map(tuple, found))


# ------------------------------------------------------------ null keys, distinct counts


@pytest.fixture(scope="module")
def with_nulls(tmp_path_factory):
    """The sample tables with missing series, members, order and customer keys."""
    root = tmp_path_factory.mktemp("nulls")
    con = duckdb.connect()
    some = {"events": ["event_type"], "lineitem": ["l_linestatus", "l_orderkey"], "orders": ["o_orderstatus", "o_orderpriority", "o_custkey"]}
    for table, cols in some.items():
        gone = ", ".join(f"CASE WHEN hash(t, {i}) % 5 = 0 THEN NULL ELSE {c} END AS {c}" for i, c in enumerate(cols))
        con.execute(f"COPY (SELECT * REPLACE ({gone}) FROM '{SF}/{table}.parquet' t) TO '{root}/{table}.parquet' (FORMAT parquet)")
    return str(root)


@pytest.mark.parametrize(
    "name",
    ["rollup_hourly", "dedupe_keyed", "tail_per_series", "features_waste_daily", "features_transport_daily", "stream_rollup_hourly",
     "stream_alert_dedup", "stream_scan_alerts", "detect_water"],
)
def test_rows_without_a_key_are_a_series(spark, with_nulls, name):
    same, found, expected, diff, names = compare(spark, duck(with_nulls), with_nulls, QUERIES[name], ORACLES[name])
    assert same, names
    assert found == expected, diff
    if name == "rollup_hourly":
        assert any("unknown" in str(r) for r in found)


def test_distinct_counts_fold_before_they_move(spark):
    rows = [("a", k) for k in [1, 1, 2, 40_000, 40_000, -5, None]] + [("b", None), ("c", 7)] * 3
    df = spark.createDataFrame(rows, "g string, k long")
    out = rollup.with_distinct(df, {"g": F.col("g")}, {"n": F.lit(1.0)}, "k", "different")
    assert {(r.g, r.n, r.different) for r in out.collect()} == {("a", 7.0, 4.0), ("b", 3.0, 0.0), ("c", 3.0, 1.0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) >= 2 and not any("k#" in line.split("hashpartitioning")[1].split("]")[0] for line in exchanges)


def test_distinct_counts_of_spread_keys_stay_small(spark):
    """A few longs of state per row of input, in a hash aggregate, however far the keys are apart."""
    keys = [-(2**63), -65, -64, -63, -1, 0, 63, 64, 10**12, 2**63 - 1, None]
    rows = [("a", k) for k in keys] * 2 + [("b", k * 10**9) for k in range(50)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, k long")
    out = rollup.with_distinct(df, {"g": F.col("g")}, {"n": F.lit(1.0)}, "k", "different")
    assert {(r.g, r.n, r.different) for r in out.collect()} == {("a", 22.0, 10.0), ("b", 50.0, 50.0), ("c", 1.0, 0.0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "bitmap" not in plan


def test_spread_keys_move_before_they_fold(spark, monkeypatch):
    """Map tasks hold no groups, however many rows a file split has, and tasks grow with the rows."""
    monkeypatch.setattr(rollup, "ROWS_A_TASK", 20, raising=False)
    rows = [(f"g{i % 3}", None if i % 11 == 0 else i * 37 % 250 * 64, float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    out = rollup.with_distinct(df, {"g": F.col("g")}, {"v": F.col("v")}, "k", "different")
    groups = {g: [(k, v) for h, k, v in rows if h == g] for g in ("g0", "g1", "g2")}
    assert {(r.g, r.v, r.different) for r in out.collect()} == {
        (g, sum(v for _, v in kv), float(len({k for k, _ in kv} - {None}))) for g, kv in groups.items()
    }
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    moves = [i for i, line in enumerate(plan) if "Exchange" in line]
    assert ", 46)" in plan[moves[-1]] and "REPARTITION_BY_NUM" in plan[moves[-1]]
    assert not any("Aggregate" in line for line in plan[moves[-1] :])
