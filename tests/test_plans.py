"""Plans and results when one series holds a third of all rows."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom.operators import clean, kpi, recent, rollup
from meterloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"

# These end in one global row, so their last step is a single partition of partial sums.
GLOBAL_ROWS = {"health_report", "scan_summary"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(
    "name",
    ["detect_all", "hourly_disaggregation", "features_waste_daily", "site_status", "scan_summary",
     "alerts_active", "future_regressors", "co2e_total", "chart_alert_merge", "model_status", "sustainability_score"],
)
def test_no_cross_joins_and_no_single_partition_steps(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name not in GLOBAL_ROWS:
        assert "SinglePartition" not in plan


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 60_000
    hot = rng.random(n) < 0.34
    series = np.where(hot, "hot", np.char.add("s", rng.integers(0, 500, n).astype(str)))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40 * 24 * 3600, n), unit="s")
    pdf = pd.DataFrame({"series": series, "ts": ts, "id": np.arange(n), "value": np.round(rng.gamma(2, 50, n), 2)})
    return pdf, spark.createDataFrame(pdf, "series string, ts timestamp_ntz, id long, value double").repartition(8)


def test_rollup_of_a_hot_series(skewed):
    pdf, df = skewed
    out = rollup.rollup(df, ["series"], "ts", "hour", {"total": "value"}).toPandas()
    want = pdf.groupby(["series", pdf.ts.dt.floor("h")]).value.sum()
    got = out.set_index(["series", "ts"]).total.reindex(want.index)
    assert len(out) == len(want)
    np.testing.assert_allclose(got, want)


def test_tail_of_a_hot_series_is_trimmed_before_the_shuffle(skewed):
    pdf, df = skewed
    out = recent.tail_per_series(df, ["series"], "ts", 100, ["id"])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    want = pdf.sort_values(["ts", "id"]).groupby("series").tail(100)
    assert sorted(r.id for r in out.select("id").collect()) == sorted(want.id)
    spikes = kpi.latest_spike(df, ["series"], "ts", "value", ["id"]).toPandas().set_index("series")
    np.testing.assert_allclose(spikes["mean"].sort_index(), want.groupby("series").value.mean().sort_index())


def test_dedupe_of_a_hot_slot(skewed):
    pdf, df = skewed
    same = df.withColumn("slot", F.lit("2024-01-01").cast("timestamp_ntz")).select("series", "slot", "ts", "id", "value")
    out = clean.dedupe_keyed(same, ["series"], "slot", order=["ts", "id"]).toPandas().set_index("series")
    want = pdf.sort_values(["ts", "id"]).groupby("series").id.first()
    assert out.id.sort_index().tolist() == want.sort_index().tolist()
