"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from meterloom.plans.catalog import QUERIES
from meterloom.session import local_session

HEADLINE = (
    "rollup_hourly",
    "dedupe_keyed",
    "interpolate_linear",
    "features_hourly",
    "features_waste_daily",
    "features_transport_daily",
    "rolling_stats_min_periods",
    "severity_tiers",
    "hourly_profile",
    "hourly_disaggregation",
    "forecast_seasonal_rolling",
    "forecast_errors",
    "forecast_ar",
    "detect_energy",
    "detect_water",
    "detect_all",
    "alerts_active",
    "tail_per_series",
    "site_status",
    "co2e_by_resource",
    "sustainability_score",
    "health_report",
    "stream_rollup_hourly",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "meterloom-bench")
    QUERIES["severity_tiers"](spark, sf).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
