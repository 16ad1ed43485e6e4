"""Results as they are served: the score with its alerts, and charts and scans on the model path."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.operators import alerts as alert_ops, detect, forecast as fc, kpi, models
from meterloom.operators.recent import tail_per_series
from meterloom.operators.rollup import rollup
from meterloom.plans.alerting import SQL_STORED, alert_table, hours_table, sql_energy
from meterloom.plans.base import KEY, SQL_DAILY, SQL_USAGE, SQL_WASTE, query, rounded, rs, saved, waste, with_
from meterloom.plans.forecasts import SQL_ERRORS, SQL_PROFILE, holdout_metrics
from meterloom.plans.kpis import SQL_SCORE, scores
from meterloom.plans.learned import FIXED_INTERCEPT, FIXED_WEIGHTS, TARGET, detect_waste_model

STEPS = len(FIXED_WEIGHTS)


@query(
    "score_card",
    with_(
        SQL_USAGE, SQL_WASTE, *SQL_SCORE,
        SQL_STORED.replace(SQL_WASTE + ", ", ""), SQL_ERRORS,
        "act AS (SELECT severity, count(*) AS n FROM stored WHERE status = 'active' GROUP BY severity)",
        """ready AS (SELECT bool_and(has) AS models_ready FROM (
                SELECT s.series, EXISTS (SELECT 1 FROM errs e WHERE e.target = s.series) AS has FROM (SELECT DISTINCT series FROM waste) s))""",
        """SELECT scored.*, coalesce((SELECT n FROM act WHERE severity = 'critical'), 0) AS active_critical,
                  coalesce((SELECT n FROM act WHERE severity = 'high'), 0) AS active_high,
                  coalesce((SELECT n FROM act WHERE severity = 'medium'), 0) AS active_medium,
                  CAST(coalesce((SELECT sum(n) FROM act), 0) AS BIGINT) AS active_total, (SELECT models_ready FROM ready) AS models_ready FROM scored""",
    ),
)
def score_card(spark, sf):
    """The score of every series, the active alerts by severity and whether every target has a model, as one result."""
    days = saved(waste(spark, sf).select("series", "date", "total"), "waste")
    names = F.array(*[F.lit(n) for n in ("seasonal_naive", "trailing_mean", "random_forest")])
    known = days.select(F.col("series").alias("target")).distinct().select("target", F.explode(names).alias("model"))
    status = fc.model_status(known, holdout_metrics(days))
    return kpi.score_card(scores(spark, sf), alert_ops.counts(alert_table(spark, sf).state()), status)


def sql_walk(name: str, src: str, value: str, span: str) -> str:
    """In-sample path of the fixed autoregression over ``src``, scaled by the range of ``span``."""
    return f"""
{name}_span AS (SELECT series, min({value}) AS lo, max({value}) AS hi FROM {span} GROUP BY series),
{name}_num AS (SELECT s.series, date, {value} AS x, lo, hi, ({value} - lo) / (hi - lo) AS v,
                      row_number() OVER (PARTITION BY s.series ORDER BY date) AS up FROM {src} s JOIN {name}_span USING (series)),
{name}_walk(series, i, vals) AS (
    SELECT series, 0, list(v ORDER BY date) FROM {name}_num WHERE up <= {STEPS} GROUP BY series
    UNION ALL
    SELECT series, i + 1, list_append(vals[2:], {FIXED_INTERCEPT}::DOUBLE + list_dot_product(vals, {list(FIXED_WEIGHTS)}::DOUBLE[]))
    FROM {name}_walk WHERE i < (SELECT max(up) - {STEPS} FROM {name}_num)),
{name} AS (SELECT n.series, n.date, n.x AS actual,
                  CASE WHEN n.up <= {STEPS} THEN n.x ELSE greatest(0, w.vals[{STEPS}] * (n.hi - n.lo) + n.lo) END AS predicted
           FROM {name}_num n LEFT JOIN {name}_walk w ON w.series = n.series AND w.i = n.up - {STEPS})"""


def recursive(*parts: str) -> str:
    return with_(*parts).replace("WITH", "WITH RECURSIVE", 1)


def usage_days(hours):
    return rollup(hours, KEY, "ts", "day", {"usage": "usage"}, out_ts="date")


def fixed_model(days):
    scale = days.groupBy(*KEY).agg(F.min("usage").alias("lo"), F.max("usage").alias("hi"))
    return models.Autoregression(FIXED_WEIGHTS, FIXED_INTERCEPT, scale)


@query(
    "detect_energy_model",
    recursive(
        SQL_DAILY, SQL_PROFILE, sql_walk("path", "daily", "usage", "daily"),
        """predicted AS (SELECT h.series, h.ts, h.usage AS actual, coalesce(y.predicted * p.fraction, h.usage) AS predicted,
                                CASE WHEN y.predicted * p.fraction IS NULL THEN 'actual' ELSE 'profile' END AS method
                         FROM hourly h LEFT JOIN path y ON y.series = h.series AND y.date = CAST(h.ts AS DATE)
                         LEFT JOIN profile p ON p.series = h.series AND p.hour = hour(h.ts))""",
        sql_energy("48 HOUR"),
        "SELECT * FROM energy_alerts",
    ),
)
def detect_energy_model(spark, sf):
    """The energy scan against a model: the in-sample path of an autoregression (of fixed weights), spread over the hours."""
    hours = hours_table(spark, sf).select("series", "ts", "usage")
    days = saved(usage_days(hours), "days")
    path = models.backcast_autoregression(fixed_model(days), days, KEY, "date", "usage").withColumnRenamed("predicted", "yhat")
    predicted = fc.disaggregate_hourly(hours, path, fc.hourly_profile(hours, KEY, "ts", "usage"), KEY, "ts", "usage")
    return detect.detect_energy(predicted, KEY, "ts", "energy_kwh")


CHART_DAYS = 60


@query(
    "water_chart_model",
    recursive(
        SQL_DAILY,
        f"tail AS (SELECT series, date, usage FROM daily QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) <= {CHART_DAYS + STEPS})",
        sql_walk("path", "tail", "usage", "daily"),
        f"chart AS (SELECT *, abs(actual - predicted) AS deviation FROM path QUALIFY row_number() OVER (PARTITION BY series ORDER BY date DESC) <= {CHART_DAYS})",
        """marked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS idx,
                             stddev_pop(deviation) OVER (PARTITION BY series) AS sd FROM chart)""",
        f"""SELECT series, date, CAST(idx AS INTEGER) AS idx, {rs('actual', 'predicted')},
                   CASE WHEN deviation <= 2 * sd THEN NULL WHEN actual > predicted THEN 'High Spike' ELSE 'Unusual Drop' END AS type,
                   CASE WHEN deviation <= 2 * sd THEN NULL WHEN deviation / (sd + 1e-9) >= 3 THEN 'critical'
                        WHEN deviation / (sd + 1e-9) >= 2 THEN 'high' ELSE 'medium' END AS severity FROM marked""",
    ),
)
def water_chart_model(spark, sf):
    """The last 60 days with the path of an autoregression (of fixed weights) seeded by the days before, and their outliers."""
    days = saved(usage_days(hours_table(spark, sf).select("series", "ts", "usage")), "days")
    tail = tail_per_series(days, KEY, "date", CHART_DAYS + STEPS).drop("age")
    path = models.backcast_autoregression(fixed_model(days), tail, KEY, "date", "usage")
    chart = tail_per_series(path, KEY, "date", CHART_DAYS).select("series", "date", "actual", "predicted")
    return rounded(detect.charted_water(saved(chart, "chart"), KEY, "date"))


@query(
    "detect_waste_model_contract",
    with_(SQL_WASTE, "SELECT series, true AS on_days, true AS residuals, true AS tiers, true AS kinds, true AS ids FROM waste GROUP BY series"),
)
def detect_waste_model_contract(spark, sf):
    """What must hold for the alerts of any fit: days and actuals of the table, residuals, tiers, kinds and ids as stated."""
    days = saved(waste(spark, sf).select("series", F.col("date").cast("timestamp_ntz").alias("ts"), F.col(TARGET).alias("total")), "waste")
    found = detect_waste_model(spark, sf).alias("a")
    own = days.alias("d").join(found, (F.col("d.series") == F.col("a.series")) & (F.col("d.ts") == F.col("a.ts")), "full")
    tier = F.when(F.col("a.sigma") >= 3, "critical").when(F.col("a.sigma") >= 2, "high").when(F.col("a.sigma") >= 1.5, "medium")
    kind = F.when(F.col("a.residual") > 0, "waste_spike").otherwise("waste_drop")
    there = F.col("a.alert_id").isNotNull()

    def holds(what):
        return F.coalesce(F.min(F.when(there, F.coalesce(what, F.lit(False)))), F.lit(True))

    gap = F.abs(F.col("a.actual") - F.col("a.predicted") - F.col("a.residual"))
    return own.groupBy(F.coalesce("d.series", "a.series").alias("series")).agg(
        holds(F.abs(F.col("d.total") - F.col("a.actual")) < 0.011).alias("on_days"),
        holds((gap < 0.021) & (F.col("a.predicted") >= 0)).alias("residuals"),
        holds(F.col("a.severity") == tier).alias("tiers"),
        holds(F.col("a.alert_type") == kind).alias("kinds"),
        (F.count_distinct("a.alert_id") == F.count_if(there)).alias("ids"),
    )
