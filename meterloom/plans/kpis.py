"""Cost, usage, diversion, emission and score queries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from meterloom.functions.numeric import safe_ratio
from meterloom.operators import emissions, kpi
from meterloom.operators.forecast import forecast_seasonal_rolling
from meterloom.operators.recent import tail_per_series
from meterloom.plans.base import (
    KEY, MEMBER, SQL_DAILY, SQL_TRIPS, SQL_USAGE, SQL_WASTE, daily, query, r, readings, rounded, rs,
    table, trips_observed, usage, waste, with_,
)
from meterloom.plans.forecasts import SQL_SEASONAL

# ---------------------------------------------------------------- recent usage


@query(
    "latest_day_totals",
    with_(
        SQL_DAILY,
        f"""SELECT series, date, {rs('usage', 'readings')} FROM daily d
            WHERE date = (SELECT max(date) FROM daily m WHERE m.series = d.series)""",
    ),
)
def latest_day_totals(spark, sf):
    return rounded(kpi.latest_day_totals(daily(spark, sf), KEY, "date", ["usage", "readings"]))


@query(
    "usage_last_7_days",
    with_(
        SQL_DAILY,
        "last7 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM daily)",
        f"""SELECT series, date, {r('usage')} AS usage, {r('sum(usage) OVER (PARTITION BY series)')} AS total
            FROM last7 WHERE age <= 7""",
    ),
)
def usage_last_7_days(spark, sf):
    return rounded(kpi.usage_last_days(daily(spark, sf), KEY, "date", "usage"))


SQL_MTD = """
latest AS (SELECT series, max(date) AS as_of FROM usage GROUP BY ALL),
mtd AS (SELECT u.series, sum(u.fuel) AS amount, max(l.as_of) AS as_of FROM usage u JOIN latest l USING (series)
        WHERE date_trunc('month', u.date) = date_trunc('month', l.as_of) GROUP BY ALL),
plan AS (SELECT u.series, avg(u.fuel) * 0.12 AS plan_per_day FROM usage u JOIN latest l USING (series)
         WHERE date_trunc('month', u.date) = date_trunc('month', l.as_of) - INTERVAL 1 MONTH GROUP BY ALL),
cost AS (SELECT series, amount, as_of, amount * 0.12 AS cost, plan_per_day * day(as_of) AS planned_cost
         FROM mtd LEFT JOIN plan USING (series)),
mtd_cost AS (SELECT *, (cost - planned_cost) / nullif(planned_cost, 0) * 100 AS change_pct FROM cost)"""


def _mtd(spark, sf):
    days = usage(spark, sf).select("series", "date", "fuel")
    plan = kpi.plan_from_last_month(days, KEY, "date", "fuel")
    return kpi.mtd_cost(days, KEY, "date", "fuel", plan)


@query(
    "mtd_cost",
    with_(
        SQL_USAGE, SQL_MTD,
        f"""SELECT series, as_of, {rs('amount', 'cost', 'planned_cost', digits=2)}, {r('change_pct', 4)} AS change_pct,
                   CASE WHEN change_pct > 0 THEN 'negative' ELSE 'positive' END AS status FROM mtd_cost""",
    ),
)
def mtd_cost(spark, sf):
    return rounded(_mtd(spark, sf), {"amount": 2, "cost": 2, "planned_cost": 2, "change_pct": 4})


@query(
    "kpi_text",
    with_(
        SQL_USAGE, SQL_MTD,
        """SELECT series, '$' || format('{:,}', CAST(round_even(cost, 0) AS BIGINT)) AS value_text,
                  CASE WHEN change_pct > 0 THEN '+' ELSE '' END || printf('%.1f', change_pct) || '%' AS change_text,
                  printf('%.1f', amount / 1e6) || 'M' AS amount_text FROM mtd_cost""",
    ),
)
def kpi_text(spark, sf):
    return kpi.kpi_text(_mtd(spark, sf)).select("series", "value_text", "change_text", "amount_text")


@query(
    "unit_kpis",
    with_(
        SQL_WASTE,
        f"""SELECT series, date, {r('population / 1e3')} AS kgal, {r('population / 1e6', 9)} AS mgal,
                   {r('population * 0.3 / 1e3')} AS reclaimed_kgal, {r('total / 2000.0')} AS short_tons FROM waste""",
    ),
)
def unit_kpis(spark, sf):
    rows = kpi.unit_kpis(waste(spark, sf), "population", "total")
    return rounded(rows.select("series", "date", "kgal", "mgal", "reclaimed_kgal", "short_tons"), {"mgal": 9})


SQL_DIVERSION_MTD = """
wlast AS (SELECT series, max(date) AS d FROM waste GROUP BY ALL),
wsum AS (SELECT w.series, sum(total) AS t, sum(recycled) AS rec FROM waste w JOIN wlast USING (series)
         WHERE date_trunc('month', w.date) = date_trunc('month', d) GROUP BY ALL),
diversion AS (SELECT series, CAST(trunc(t / 2000.0) AS INTEGER) AS waste_mtd_tons,
                     CAST(trunc(coalesce(rec / nullif(t, 0), 0) * 100) AS INTEGER) AS diversion_pct FROM wsum)"""


@query("diversion_mtd", with_(SQL_WASTE, SQL_DIVERSION_MTD, "SELECT * FROM diversion"))
def diversion_mtd(spark, sf):
    return kpi.diversion_mtd(waste(spark, sf), KEY, "date", "total", "recycled")


@query(
    "daily_stats",
    with_(
        SQL_USAGE, SQL_WASTE, SQL_DIVERSION_MTD,
        """SELECT u.series, CAST(trunc(fuel) AS BIGINT) AS energy_today, CAST(trunc(trips) AS BIGINT) AS water_today,
                  waste_mtd_tons, diversion_pct
           FROM usage u LEFT JOIN diversion USING (series)
           WHERE u.date = (SELECT max(date) FROM usage m WHERE m.series = u.series)""",
    ),
)
def daily_stats(spark, sf):
    return kpi.daily_stats(
        usage(spark, sf), waste(spark, sf), KEY, "date", "fuel", "trips", "total", "recycled"
    )


@query(
    "headline_text",
    with_(
        SQL_USAGE, SQL_WASTE, SQL_DIVERSION_MTD,
        """SELECT u.series, CAST(trunc(fuel) AS BIGINT) || ' kWh' AS today_usage, printf('%.0f', trunc(trips) / 1000) || 'k Gal' AS daily_consumption,
                  printf('%.0f', trunc(trips) * 0.3 / 1000) || 'k Gal' AS recycled_water, waste_mtd_tons || ' Tons' AS total_waste,
                  diversion_pct || '%' AS diversion_rate
           FROM usage u LEFT JOIN diversion USING (series)
           WHERE u.date = (SELECT max(date) FROM usage m WHERE m.series = u.series)""",
    ),
)
def headline_text(spark, sf):
    stats = kpi.daily_stats(
        usage(spark, sf), waste(spark, sf), KEY, "date", "fuel", "trips", "total", "recycled"
    )
    return kpi.headline_text(stats, KEY)


@query(
    "top_consumer",
    with_(
        SQL_TRIPS,
        "tl AS (SELECT *, max(date) OVER (PARTITION BY series) AS latest FROM trips)",
        "tt AS (SELECT series, member, sum(fuel) AS total FROM tl WHERE date = latest GROUP BY ALL)",
        "tr AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY total DESC, member DESC) AS rn FROM tt)",
        f"SELECT series, member AS top_consumer, {r('total', 2)} AS total FROM tr WHERE rn = 1",
    ),
)
def top_consumer(spark, sf):
    return rounded(kpi.top_consumer(trips_observed(spark, sf), KEY, "member", "date", "fuel"), 2)


# ---------------------------------------------------------------- spikes and sites


@query(
    "tail_per_series",
    f"""SELECT coalesce(event_type, 'unknown') AS series, event_id, ts, {r('value', 4)} AS value, CAST(rn AS INTEGER) AS age FROM (
          SELECT *, row_number() OVER (PARTITION BY coalesce(event_type, 'unknown') ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        WHERE rn <= 100""",
)
def tail(spark, sf):
    rows = readings(spark, sf).select("series", "event_id", "ts", "value")
    return rounded(tail_per_series(rows, KEY, "ts", 100, ["event_id"]), 4)


SQL_SPIKE = """
last100 AS (SELECT coalesce(event_type, 'unknown') AS series, value, row_number() OVER (
              PARTITION BY coalesce(event_type, 'unknown') ORDER BY ts DESC, event_id DESC) AS age FROM events),
spike AS (SELECT series, avg(value) AS mean, stddev_samp(value) AS std, max(value) FILTER (age = 1) AS latest
          FROM last100 WHERE age <= 100 GROUP BY ALL)"""


@query(
    "building_latest_spike",
    with_(
        SQL_SPIKE,
        f"""SELECT series, {rs('mean', 'std', 'latest')}, {r('(latest - mean) / nullif(mean, 0) * 100')} AS excess_pct,
                   CAST(coalesce(latest > mean + 2 * std, false) AS INTEGER) AS is_spike FROM spike""",
    ),
)
def building_latest_spike(spark, sf):
    rows = readings(spark, sf).select("series", "event_id", "ts", "value")
    return rounded(kpi.latest_spike(rows, KEY, "ts", "value", ["event_id"]))


SQL_TAIL_SPIKE = """
spent AS (SELECT o_orderpriority AS series, o_totalprice AS v, row_number() OVER (
            PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders),
hit AS (SELECT series, avg(v) AS m, stddev_samp(v) AS s, max(v) FILTER (age = 1) AS x FROM spent WHERE age <= 100 GROUP BY ALL)"""


@query(
    "spike_text",
    with_(
        SQL_TAIL_SPIKE,
        """SELECT series, series AS location, '+' || printf('%.0f', (x - m) / m * 100) || '% expected usage' AS details
           FROM hit WHERE x > m + 0.25 * s""",
    ),
)
def spike_text(spark, sf):
    """Priorities whose latest order exceeds mean + 0.25 stds of their last 100, as text."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"), "o_orderkey", "o_totalprice"
    )
    spikes = kpi.latest_spike(rows, KEY, "ts", "o_totalprice", ["o_orderkey"], sigmas=0.25)
    return kpi.spike_text(spikes, KEY).withColumn("location", F.upper("location"))


def site_waste(spark, sf):
    """Waste per site (nation) and day.

    Rows fold to supplier and day before the supplier join, so a supplier with a
    large share of the rows cannot skew it.
    """
    recycled = F.col("l_returnflag") == "R"
    folded = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(
            F.sum("l_quantity").alias("total"),
            F.sum(F.when(recycled, F.col("l_quantity")).otherwise(0.0)).alias("recycled"),
            F.sum("l_extendedprice").alias("spend"),
        )
    )
    homes = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("site_id")
    )
    return folded.join(homes, "l_suppkey").groupBy("site_id", "date").agg(
        *[F.sum(c).alias(c) for c in ("total", "recycled", "spend")]
    )


def sites(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("site_id"), F.col("n_name").alias("site"))


SQL_SITE_WASTE = """
site_days AS (SELECT s_nationkey AS site_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS total,
                     sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS recycled,
                     sum(l_extendedprice) AS spend
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


@query(
    "site_status",
    with_(
        SQL_SITE_WASTE,
        "aged AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) AS age FROM site_days)",
        """st AS (SELECT site_id, avg(total) AS m, stddev_samp(total) AS s, max(total) FILTER (age = 1) AS x
                  FROM aged WHERE age <= 100 GROUP BY ALL)""",
        """SELECT n_nationkey AS site_id, n_name AS site,
                  CASE WHEN x > m + 1.5 * s THEN 'critical' ELSE 'normal' END AS status
           FROM nation LEFT JOIN st ON site_id = n_nationkey""",
    ),
)
def site_status(spark, sf):
    """Sites whose latest day exceeds mean + 1.5 stds of their last 100 days."""
    days = site_waste(spark, sf).select("site_id", "date", "total")
    spikes = kpi.latest_spike(days, ["site_id"], "date", "total", [], sigmas=1.5)
    return kpi.site_status(sites(spark, sf), spikes, "site_id")


@query(
    "sites_flagged",
    with_(
        SQL_SITE_WASTE,
        "aged AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) AS age FROM site_days)",
        """st AS (SELECT site_id, avg(total) AS m, stddev_samp(total) AS s, max(total) FILTER (age = 1) AS x
                  FROM aged WHERE age <= 100 GROUP BY ALL)""",
        """SELECT n_nationkey AS site_id, n_name AS site FROM nation
           WHERE n_nationkey IN (SELECT site_id FROM st WHERE x > m + 0.5 * s)""",
    ),
)
def sites_flagged(spark, sf):
    """The sites whose latest day exceeds mean + 0.5 stds, without the others."""
    days = site_waste(spark, sf).select("site_id", "date", "total")
    spikes = kpi.latest_spike(days, ["site_id"], "date", "total", [], sigmas=0.5)
    return kpi.flagged_sites(sites(spark, sf), spikes, "site_id")


# ---------------------------------------------------------------- emissions

MEASURES = {
    "Electricity": "fuel",
    "Water": "trips",
    "Gasoline": "riders",
    "Waste_Landfill": "landfill",
    "Waste_Recycled": "recycled",
}


def _co2e(spark, sf):
    """Yearly emissions per series; the factor table lacks Water, so its default applies."""
    both = usage(spark, sf).unionByName(waste(spark, sf), allowMissingColumns=True)
    yearly = both.withColumn("year", F.year("date"))
    factors = emissions.factor_table(spark, without=["Water"])
    return emissions.co2e_by_resource(yearly, ["series", "year"], MEASURES, factors)


SQL_CO2E = """
factors(resource_type, factor) AS (VALUES ('Electricity', 0.43::DOUBLE), ('Water', 0.00095::DOUBLE),
    ('Gasoline', 8.887::DOUBLE), ('Waste_Landfill', 0.544::DOUBLE), ('Waste_Recycled', -0.5::DOUBLE)),
amounts AS (
    SELECT series, date, 'Electricity' AS resource_type, fuel AS amount FROM usage
    UNION ALL SELECT series, date, 'Water', trips FROM usage
    UNION ALL SELECT series, date, 'Gasoline', riders FROM usage
    UNION ALL SELECT series, date, 'Waste_Landfill', landfill FROM waste
    UNION ALL SELECT series, date, 'Waste_Recycled', recycled FROM waste),
co2e AS (SELECT series, CAST(year(date) AS INTEGER) AS year, resource_type, sum(amount) AS amount,
                sum(amount) * any_value(factor) AS co2e_kg FROM amounts JOIN factors USING (resource_type) GROUP BY ALL)"""


@query(
    "co2e_by_resource",
    with_(SQL_USAGE, SQL_WASTE, SQL_CO2E, f"SELECT series, year, resource_type, {rs('amount', 'co2e_kg', digits=2)} FROM co2e"),
)
def co2e_by_resource(spark, sf):
    return rounded(_co2e(spark, sf), 2)


@query(
    "co2e_total",
    with_(SQL_USAGE, SQL_WASTE, SQL_CO2E, f"SELECT series, year, {r('sum(co2e_kg)', 2)} AS co2e_total_kg FROM co2e GROUP BY ALL"),
)
def co2e_total(spark, sf):
    return rounded(emissions.co2e_total(_co2e(spark, sf), ["series", "year"]), 2)


# ---------------------------------------------------------------- score and outlook


SQL_SCORE = [
    "ua AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM usage)",
    """up AS (SELECT series, avg(fuel) FILTER (age <= 30) AS fn, avg(fuel) FILTER (age BETWEEN 31 AND 60) AS fo,
                     avg(trips) FILTER (age <= 30) AS tn, avg(trips) FILTER (age BETWEEN 31 AND 60) AS tb,
                     count(*) FILTER (age <= 60) AS n FROM ua GROUP BY ALL)""",
    "wa AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM waste)",
    """ws AS (SELECT series, CAST(trunc(least(100, avg(coalesce(recycled / nullif(total, 0), 0)) * 100)) AS INTEGER) AS waste_score
              FROM wa WHERE age <= 30 GROUP BY ALL)""",
    """sc AS (SELECT series,
                CASE WHEN n >= 60 THEN CAST(trunc(greatest(0, least(100, 75 + (fo - fn) / fo * 100))) AS INTEGER) END AS energy_score,
                CASE WHEN n >= 60 THEN CAST(trunc(greatest(0, least(100, 75 + (tb - tn) / tb * 100))) AS INTEGER) END AS water_score,
                waste_score, n AS basis_days FROM up LEFT JOIN ws USING (series))""",
    """tot AS (SELECT *, (coalesce(energy_score * 0.4::DOUBLE, 0) + coalesce(water_score * 0.3::DOUBLE, 0) + coalesce(waste_score * 0.3::DOUBLE, 0))
               / nullif(round((energy_score IS NOT NULL)::INT * 0.4::DOUBLE + (water_score IS NOT NULL)::INT * 0.3::DOUBLE
                      + (waste_score IS NOT NULL)::INT * 0.3::DOUBLE, 9), 0) AS score FROM sc)""",
    f"""scored AS (SELECT series, basis_days, energy_score, water_score, waste_score, {r('score', 1)} AS score,
                       {r('energy_score * 0.4::DOUBLE', 1)} AS energy_weighted, {r('water_score * 0.3::DOUBLE', 1)} AS water_weighted,
                       {r('waste_score * 0.3::DOUBLE', 1)} AS waste_weighted,
                       CASE WHEN score IS NULL THEN NULL WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B+' WHEN score >= 70 THEN 'B'
                            WHEN score >= 60 THEN 'C+' ELSE 'C' END AS grade,
                       CASE WHEN score IS NULL THEN NULL WHEN score < 50 THEN '#DC3545' WHEN score < 75 THEN '#FFC107' ELSE '#28A745' END AS gauge_colour
            FROM tot)""",
]


def scores(spark, sf):
    days = waste(spark, sf).withColumn("diversion_rate", safe_ratio("recycled", "total"))
    return rounded(
        kpi.sustainability_score(usage(spark, sf), days, KEY, "date", "fuel", "trips", "diversion_rate"), 1
    )


@query("sustainability_score", with_(SQL_USAGE, SQL_WASTE, *SQL_SCORE, "SELECT * FROM scored"))
def sustainability_score(spark, sf):
    return scores(spark, sf)


@query(
    "forecast_overage",
    with_(
        SQL_WASTE, SQL_SEASONAL.format(periods=30),
        "fa AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM waste)",
        "act AS (SELECT series, sum(total) AS actual_30 FROM fa WHERE age <= 30 GROUP BY ALL)",
        "proj AS (SELECT series, sum(forecast) AS projected FROM seasonal GROUP BY ALL)",
        "ov AS (SELECT *, (projected - actual_30) / actual_30 * 100 AS pct FROM proj JOIN act USING (series))",
        f"""SELECT series, {rs('projected', 'actual_30', digits=4)}, {r('pct', 4)} AS overage_pct,
                   CASE WHEN pct > 0 THEN '+' || printf('%.0f', pct) || '% Overage'
                        ELSE printf('%.0f', abs(pct)) || '% Under Budget' END AS label FROM ov""",
    ),
)
def forecast_overage(spark, sf):
    days = waste(spark, sf)
    projected = forecast_seasonal_rolling(days, KEY, "date", "total", 30)
    return rounded(kpi.forecast_overage(projected, days, KEY, "date", "total"), 4)
