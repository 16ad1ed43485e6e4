"""Scans, ingest, cleaning, rollups and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom import schemas
from meterloom.operators import clean, recent, rollup
from meterloom.operators.health import health_report
from meterloom.plans.base import (
    CUTOFF, HOURLY_COLS, HOURLY_MEANS, HOURLY_SUMS, KEY, MEMBER, SQL_DAILY, SQL_GRID, SQL_HOURLY,
    SQL_OBSERVED, SQL_TRIPS, SQL_USAGE, SQL_WASTE, SQL_WASTE_GRID, USAGE_VALUES, daily, hourly,
    hourly_grid, hourly_observed, query, r, readings, rounded, rs, saved, sql_fill, sql_spine, table,
    trips_observed, usage, waste, waste_observed, with_,
)
from meterloom.session import scratch_path
from meterloom.sources import csv_tables
from meterloom.sources.ingest import ingest

# ---------------------------------------------------------------- scans


@query(
    "scan_hourly",
    with_(
        SQL_OBSERVED,
        f"""SELECT series AS building, count(*) AS row_count, {r('sum(usage)', 2)} AS energy_kwh,
                   {r('avg(level)')} AS temperature_f, CAST(sum(readings) AS BIGINT) AS occupancy,
                   min(ts) AS first_ts, max(ts) AS last_ts FROM obs GROUP BY ALL""",
    ),
)
def scan_hourly(spark, sf):
    """Hourly readings per building written as CSV and scanned back with the energy schema."""
    path = scratch_path(spark, "energy-csv")
    rows = hourly_observed(spark, sf).select(
        F.col("ts").alias("timestamp"),
        F.col("series").alias("building"),
        F.col("usage").alias("energy_kwh"),
        F.col("level").alias("temperature_f"),
        F.col("readings").cast("int").alias("occupancy"),
    )
    csv_tables.write_csv(rows, path)
    scanned = csv_tables.load_energy(spark, path).groupBy("building").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("energy_kwh").alias("energy_kwh"),
        F.avg("temperature_f").alias("temperature_f"),
        F.sum("occupancy").alias("occupancy"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    return rounded(scanned, {"energy_kwh": 2})


@query(
    "scan_hourly_water",
    with_(
        SQL_OBSERVED,
        f"""SELECT series AS zone, count(*) AS row_count, {r('sum(usage)', 2)} AS water_gallons, {r('avg(level)')} AS pressure_psi,
                   min(ts) AS first_ts FROM obs GROUP BY ALL""",
    ),
)
def scan_hourly_water(spark, sf):
    """Hourly readings per zone as CSV with its columns in another order, scanned with the water schema."""
    path = scratch_path(spark, "water-csv")
    rows = hourly_observed(spark, sf).select(
        F.col("level").alias("pressure_psi"), F.col("series").alias("zone"), F.col("usage").alias("water_gallons"),
        F.col("ts").alias("timestamp"),
    )
    csv_tables.write_csv(rows, path)
    scanned = csv_tables.load_water(spark, path).groupBy("zone").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("water_gallons").alias("water_gallons"),
        F.avg("pressure_psi").alias("pressure_psi"),
        F.min("timestamp").alias("first_ts"),
    )
    return rounded(scanned, {"water_gallons": 2})


@query(
    "scan_transport",
    f"""SELECT o_orderpriority AS vehicle_type, count(*) AS row_count, {r('sum(o_totalprice)', 2)} AS fuel_gallons,
               sum(o_custkey % 100)::BIGINT AS trips_count, min(CAST(o_orderdate AS DATE)) AS first_date
        FROM orders GROUP BY ALL""",
)
def scan_transport(spark, sf):
    """Trips as CSV, scanned with the transport schema."""
    path = scratch_path(spark, "transport-csv")
    rows = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("vehicle_type"),
        F.col("o_totalprice").alias("fuel_gallons"), (F.col("o_custkey") % 100).cast("int").alias("trips_count"),
        F.col("o_totalprice").alias("miles_driven"),
    )
    csv_tables.write_csv(rows, path)
    scanned = csv_tables.load_transport(spark, path).groupBy("vehicle_type").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("fuel_gallons").alias("fuel_gallons"),
        F.sum("trips_count").alias("trips_count"),
        F.min("date").alias("first_date"),
    )
    return rounded(scanned, 2)


@query(
    "scan_factors",
    """SELECT 'unit-' || p_brand AS resource_type, count(*) AS row_count, max(p_size)::DOUBLE AS co2e_kg_per_unit
       FROM part GROUP BY ALL""",
)
def scan_factors(spark, sf):
    """A factor file with a row for each part, scanned with the factor schema."""
    path = scratch_path(spark, "factors-csv")
    rows = table(spark, sf, "part").select(
        F.lit("catalogue").alias("source"), F.col("p_size").cast("double").alias("co2e_kg_per_unit"),
        F.concat(F.lit("unit-"), "p_brand").alias("resource_type"), F.lit("piece").alias("unit"),
    )
    csv_tables.write_csv(rows, path)
    return csv_tables.load_emission_factors(spark, path).groupBy("resource_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("co2e_kg_per_unit").alias("co2e_kg_per_unit")
    )


@query(
    "scan_daily",
    with_(
        SQL_WASTE_GRID,
        f"""SELECT year(date) AS year, count(*) AS row_count, {r('sum(total)', 2)} AS total_waste_lbs,
                   {r('sum(recycled)', 2)} AS recycled_lbs FROM waste_obs GROUP BY ALL""",
    ),
)
def scan_daily(spark, sf):
    """Daily waste written as CSV and scanned back with the waste schema."""
    path = scratch_path(spark, "waste-csv")
    rows = waste_observed(spark, sf).select(
        "date",
        F.col("total").alias("total_waste_lbs"),
        F.col("recycled").alias("recycled_lbs"),
        F.col("landfill").alias("landfill_lbs"),
        F.col("population").cast("int").alias("population_count"),
    )
    csv_tables.write_csv(rows, path)
    scanned = csv_tables.load_waste(spark, path).groupBy(F.year("date").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("total_waste_lbs").alias("total_waste_lbs"),
        F.sum("recycled_lbs").alias("recycled_lbs"),
    )
    return rounded(scanned, 2)


@query(
    "ingest_report",
    """SELECT 'events' AS source, 'loaded' AS status, count(*) AS row_count, NULL::BIGINT AS corrupt_count FROM events
       UNION ALL SELECT 'lineitem', 'loaded', count(*), NULL FROM lineitem
       UNION ALL SELECT 'orders', 'loaded', count(*), NULL FROM orders
       UNION ALL SELECT 'fleet', 'failed', NULL, NULL""",
)
def ingest_report(spark, sf):
    """One of the sources does not exist; it is reported and the others load."""
    sources = ("events", "lineitem", "orders", "fleet")
    done = ingest({s: (lambda s=s: table(spark, sf, s)) for s in sources})
    return done.report(spark).drop("error")


# ---------------------------------------------------------------- duplicates, gaps, fills


@query(
    "dedupe_keyed",
    f"""SELECT coalesce(event_type, 'unknown') AS series, date_trunc('hour', ts) AS slot, ts, event_id, value, level FROM (
          SELECT *, CAST(user_id AS DOUBLE) AS level, row_number() OVER (
            PARTITION BY coalesce(event_type, 'unknown'), date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def dedupe_keyed(spark, sf):
    """The first reading of every series and hour."""
    from meterloom.functions.timeparts import floor_hour

    rows = readings(spark, sf).drop("reading").withColumn("slot", floor_hour("ts"))
    return clean.dedupe_keyed(rows, KEY, "slot", order=["ts", "event_id"])


@query(
    "gapfill_hourly",
    with_(SQL_GRID, f"SELECT series, ts, {rs('usage', 'level')}, CAST(readings AS BIGINT) AS readings, is_observed FROM grid"),
)
def gapfill_hourly(spark, sf):
    grid = hourly_grid(spark, sf)
    return rounded(grid.withColumn("readings", F.col("readings").cast("long")))


SQL_TRIPS_GRID = SQL_TRIPS + "," + sql_spine("trips", "trips_grid", "date", USAGE_VALUES, "DAY", "series, member")


@query(
    "gapfill_daily",
    with_(SQL_TRIPS_GRID, f"SELECT series, member, date, {rs('fuel', digits=2)}, trips, riders, is_observed FROM trips_grid"),
)
def gapfill_daily(spark, sf):
    return rounded(clean.gapfill(trips_observed(spark, sf), MEMBER, "date", "day"), {"fuel": 2, "trips": 2, "riders": 2})


SQL_INTERPOLATED = with_(SQL_HOURLY, f"SELECT series, ts, {rs(*HOURLY_COLS)} FROM hourly")


@query("interpolate_linear", SQL_INTERPOLATED)
def interpolate_linear(spark, sf):
    return rounded(hourly(spark, sf))


#: Seconds of a block of hours, and of one of days, where a long series is split over tasks.
HOURS_BLOCK, DAYS_BLOCK = 240 * 3600, 365 * 86400


@query("interpolate_in_blocks", SQL_INTERPOLATED)
def interpolate_in_blocks(spark, sf):
    """The same in blocks of ten days, so that one long series is the work of many tasks."""
    observed = saved(hourly_observed(spark, sf), "observed-hours")
    grid = saved(clean.gapfill(observed, KEY, "ts", "hour", HOURS_BLOCK).drop("is_observed"), "hour-grid")
    return rounded(clean.interpolate_linear(grid, KEY, "ts", HOURLY_COLS, HOURS_BLOCK))


SQL_FILLED = with_(
    SQL_TRIPS_GRID,
    sql_fill("trips_grid", "filled", "date", USAGE_VALUES, "series, member"),
    f"SELECT series, member, date, {rs('fuel', digits=2)}, trips, riders FROM filled",
)


@query("fill_forward_back", SQL_FILLED)
def fill_forward_back(spark, sf):
    grid = clean.gapfill(trips_observed(spark, sf), MEMBER, "date", "day").drop("is_observed")
    return rounded(clean.fill_forward_back(grid, MEMBER, "date", USAGE_VALUES), {c: 2 for c in USAGE_VALUES})


@query("fill_in_blocks", SQL_FILLED)
def fill_in_blocks(spark, sf):
    """The same in blocks of a year."""
    observed = saved(trips_observed(spark, sf), "observed-trips")
    grid = saved(clean.gapfill(observed, MEMBER, "date", "day", DAYS_BLOCK).drop("is_observed"), "day-grid")
    return rounded(clean.fill_forward_back(grid, MEMBER, "date", USAGE_VALUES, DAYS_BLOCK), {c: 2 for c in USAGE_VALUES})


@query(
    "dropna_target",
    with_(SQL_GRID, "SELECT series, count(*) AS kept, min(ts) AS first_ts, max(ts) AS last_ts FROM grid WHERE usage IS NOT NULL GROUP BY ALL"),
)
def dropna_target(spark, sf):
    """What is left of every series without the hours that have no target."""
    kept = clean.drop_missing_target(hourly_grid(spark, sf), "usage")
    return kept.groupBy("series").agg(
        F.count(F.lit(1)).alias("kept"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "split_counts",
    with_(
        SQL_WASTE,
        f"""SELECT series, CASE WHEN date <= DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS part,
                   count(*) AS day_count, min(date) AS first_date, max(date) AS last_date FROM waste GROUP BY ALL""",
    ),
)
def split_counts(spark, sf):
    train, test = clean.split_train_test(waste(spark, sf), "date", CUTOFF)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("series", "part").agg(
        F.count(F.lit(1)).alias("day_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "impute_median",
    with_(
        SQL_USAGE,
        f"med AS (SELECT series, median(trips) AS med FROM usage_grid WHERE date <= DATE '{CUTOFF}' GROUP BY ALL)",
        f"SELECT series, date, {r('coalesce(trips, med)', 4)} AS trips FROM usage_grid LEFT JOIN med USING (series)",
    ),
)
def impute_median(spark, sf):
    """Days without trips take the training median of their series."""
    from meterloom.operators.rollup import rollup as roll

    days = roll(trips_observed(spark, sf), KEY, "date", "day", {"trips": "trips"})
    grid = clean.gapfill(days, KEY, "date", "day").select("series", "date", "trips")
    train, _ = clean.split_train_test(grid, "date", CUTOFF)
    return rounded(clean.impute_median(grid, train, KEY, ["trips"]), 4)


@query(
    "minmax_scale",
    with_(
        SQL_WASTE,
        f"s AS (SELECT series, min(total) AS lo, max(total) AS hi FROM waste WHERE date <= DATE '{CUTOFF}' GROUP BY ALL)",
        "sc AS (SELECT series, date, total, lo, hi, coalesce((total - lo) / nullif(hi - lo, 0), 0) AS scaled FROM waste JOIN s USING (series))",
        f"SELECT series, date, {r('scaled')} AS scaled, {r('scaled * (hi - lo) + lo', 4)} AS restored FROM sc",
    ),
)
def minmax_scale(spark, sf):
    from meterloom.functions.numeric import minmax, minmax_inverse

    days = waste(spark, sf).select("series", "date", "total")
    train, _ = clean.split_train_test(days, "date", CUTOFF)
    scale = train.groupBy("series").agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    scaled = days.join(scale, "series").withColumn("scaled", minmax("total", "lo", "hi"))
    return rounded(scaled.select("series", "date", "scaled", minmax_inverse("scaled", "lo", "hi").alias("restored")), {"restored": 4})


@query(
    "trailing_window",
    with_(
        SQL_HOURLY,
        f"""SELECT series, ts, {rs('usage')} FROM hourly h
            WHERE ts >= (SELECT max(ts) FROM hourly m WHERE m.series = h.series) - INTERVAL 48 HOUR""",
    ),
)
def trailing_window(spark, sf):
    return rounded(recent.trailing_range(hourly(spark, sf), KEY, "ts", "48 hours").select("series", "ts", "usage"))


# ---------------------------------------------------------------- rollups


@query(
    "rollup_hourly",
    with_(
        SQL_GRID,
        f"SELECT series, ts, {r('coalesce(usage, 0)', 4)} AS usage, coalesce(readings, 0) AS readings, {rs('level')} FROM grid",
    ),
)
def rollup_hourly(spark, sf):
    hours = rollup.resample(readings(spark, sf), KEY, "ts", "hour", HOURLY_SUMS, HOURLY_MEANS)
    return rounded(hours, {"usage": 4})


@query("rollup_daily", with_(SQL_DAILY, f"SELECT series, date, {rs('usage', 'readings', 'level')} FROM daily"))
def rollup_daily(spark, sf):
    return rounded(daily(spark, sf))


@query("rollup_transport_daily", with_(SQL_USAGE, f"SELECT series, date, {rs('fuel', digits=2)}, trips, riders FROM usage"))
def rollup_transport_daily(spark, sf):
    return rounded(usage(spark, sf), 2)


SQL_PROFILE = "SELECT '{n}' AS table_name, count(*) AS row_count, count(*) - count({v}) AS null_count, " \
    "CAST(min({t}) AS DATE) AS first_date, CAST(max({t}) AS DATE) AS last_date, " \
    "round(avg({v}) + 1e-5, 2) AS mean, round(stddev_samp({v}) + 1e-5, 2) AS std, " \
    "CASE WHEN count(*) = count({v}) THEN 'ok' ELSE 'has_nulls' END AS status FROM {n}"


@query(
    "health_report",
    with_(
        SQL_DAILY, SQL_WASTE, SQL_USAGE,
        " UNION ALL ".join(
            SQL_PROFILE.format(n=n, t=t, v=v)
            for n, t, v in (
                ("grid", "ts", "usage"), ("hourly", "ts", "usage"), ("daily", "date", "usage"),
                ("waste", "date", "total"), ("usage", "date", "fuel"),
            )
        ),
    ),
)
def health(spark, sf):
    grid = saved(hourly_grid(spark, sf).drop("is_observed"), "grid")
    hours = clean.interpolate_linear(grid, KEY, "ts", ["usage"])
    days = rollup.rollup(hours, KEY, "ts", "day", {"usage": "usage"}, out_ts="date")
    return health_report(
        [
            (grid, "grid", "ts", "usage"),
            (hours, "hourly", "ts", "usage"),
            (days, "daily", "date", "usage"),
            (waste(spark, sf), "waste", "date", "total"),
            (usage(spark, sf), "usage", "date", "fuel"),
        ]
    )
