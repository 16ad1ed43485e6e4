"""Cost, usage, diversion and score KPIs per site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterloom.functions.numeric import clamp, safe_ratio
from meterloom.functions.severity import SEVERITY_ORDER
from meterloom.functions.text import currency, decimal_text, percent_text, signed, title_words
from meterloom.operators.recent import latest_day, month_start, month_to_date, tail_per_series
from meterloom.operators.windows import whole

# Tariff, pounds per short ton, reclaimed share of water.
COST_PER_KWH = 0.12
LBS_PER_TON = 2000.0
RECLAIMED_SHARE = 0.30

# Score weights, neutral score, grade bands and gauge bands.
WEIGHTS = {"energy": 0.4, "water": 0.3, "waste": 0.3}
NEUTRAL_SCORE = 75
GRADES = ((90, "A"), (80, "B+"), (70, "B"), (60, "C+"))
LOWEST_GRADE = "C"
GAUGE = ((50, "#DC3545"), (75, "#FFC107"))
GAUGE_TOP = "#28A745"


def mtd_cost(
    daily: DataFrame, keys: Sequence[str], date: str, col: str, plan: DataFrame
) -> DataFrame:
    """Month-to-date cost against a planned cost per day. ``plan``: keys, plan_per_day."""
    mtd = (
        month_to_date(daily, keys, date)
        .groupBy(*keys)
        .agg(F.sum(col).alias("amount"), F.max(date).alias("as_of"))
    )
    cost, planned = F.col("cost"), F.col("planned_cost")
    return (
        mtd.join(plan, list(keys), "left")
        .withColumn("cost", F.col("amount") * COST_PER_KWH)
        .withColumn("planned_cost", F.col("plan_per_day") * F.dayofmonth("as_of"))
        .withColumn("change_pct", (cost - planned) / F.nullif(planned, F.lit(0.0)) * 100)
        .withColumn("status", F.when(F.col("change_pct") > 0, "negative").otherwise("positive"))
        .drop("plan_per_day")
    )


def plan_from_last_month(daily: DataFrame, keys: Sequence[str], date: str, col: str) -> DataFrame:
    """Planned cost per day: the mean daily cost of the month before the latest one."""
    latest = F.max(date).over(whole(keys))
    before = F.add_months(month_start("_latest"), -1)
    return (
        daily.withColumn("_latest", latest)
        .filter(month_start(date) == before)
        .groupBy(*keys)
        .agg((F.avg(col) * COST_PER_KWH).alias("plan_per_day"))
    )


def kpi_text(df: DataFrame) -> DataFrame:
    """Display strings of an ``mtd_cost`` frame."""
    change = F.col("change_pct")
    return df.withColumns(
        {
            "value_text": currency("cost"),
            "change_text": signed(change, percent_text(change)),
            "amount_text": F.concat(decimal_text(F.col("amount") / 1e6, 1), F.lit("M")),
        }
    )


def latest_day_totals(
    daily: DataFrame, keys: Sequence[str], date: str, cols: Sequence[str]
) -> DataFrame:
    return latest_day(daily, keys, date).groupBy(*keys, date).agg(*[F.sum(c).alias(c) for c in cols])


def usage_last_days(
    daily: DataFrame, keys: Sequence[str], date: str, col: str, days: int = 7
) -> DataFrame:
    """The last whole days of each series and their total."""
    recent = tail_per_series(daily, keys, date, days)
    return recent.select(*keys, date, col, F.sum(col).over(whole(keys)).alias("total"))


def unit_kpis(df: DataFrame, gallons: str, pounds: str) -> DataFrame:
    """Unit conversions for display."""
    return df.withColumns(
        {
            "kgal": F.col(gallons) / 1e3,
            "mgal": F.col(gallons) / 1e6,
            "reclaimed_kgal": F.col(gallons) * RECLAIMED_SHARE / 1e3,
            "short_tons": F.col(pounds) / LBS_PER_TON,
        }
    )


def diversion_mtd(
    waste: DataFrame, keys: Sequence[str], date: str, total: str, recycled: str, composted: str = "composted_lbs"
) -> DataFrame:
    """Month-to-date tons and diversion %, both truncated. Compost counts if measured."""
    extra = F.col(composted) if composted in waste.columns else F.lit(0.0)
    sums = (
        month_to_date(waste, keys, date)
        .groupBy(*keys)
        .agg(
            F.sum(total).alias("_total"),
            F.sum(F.coalesce(recycled, F.lit(0.0)) + F.coalesce(extra, F.lit(0.0))).alias("_diverted"),
        )
    )
    return sums.select(
        *keys,
        (F.col("_total") / LBS_PER_TON).cast("int").alias("waste_mtd_tons"),
        (safe_ratio("_diverted", "_total") * 100).cast("int").alias("diversion_pct"),
    )


def daily_stats(
    usage: DataFrame,
    waste: DataFrame,
    keys: Sequence[str],
    date: str,
    energy: str,
    water: str,
    total: str,
    recycled: str,
) -> DataFrame:
    """Headline figures: latest day's energy and water, month-to-date waste."""
    today = latest_day_totals(usage, keys, date, [energy, water])
    return today.join(diversion_mtd(waste, keys, date, total, recycled), list(keys), "left").select(
        *keys,
        F.col(energy).cast("long").alias("energy_today"),
        F.col(water).cast("long").alias("water_today"),
        "waste_mtd_tons",
        "diversion_pct",
    )


def headline_text(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Display strings of a ``daily_stats`` frame."""
    number = lambda c: F.col(c).cast("string")
    gallons = lambda share: decimal_text(F.col("water_today") * share / 1000, 0)
    return stats.select(
        *keys,
        F.concat(number("energy_today"), F.lit(" kWh")).alias("today_usage"),
        F.concat(gallons(1.0), F.lit("k Gal")).alias("daily_consumption"),
        F.concat(gallons(RECLAIMED_SHARE), F.lit("k Gal")).alias("recycled_water"),
        F.concat(number("waste_mtd_tons"), F.lit(" Tons")).alias("total_waste"),
        F.concat(number("diversion_pct"), F.lit("%")).alias("diversion_rate"),
    )


def top_consumer(
    daily: DataFrame, keys: Sequence[str], member: str, date: str, col: str
) -> DataFrame:
    """Member with the largest total on each site's latest day; ties go to the last name."""
    return (
        latest_day(daily, keys, date)
        .groupBy(*keys, member)
        .agg(F.sum(col).alias("total"))
        .groupBy(*keys)
        .agg(F.max(F.struct("total", member)).alias("_top"))
        .select(*keys, F.col(f"_top.{member}").alias("top_consumer"), F.col("_top.total").alias("total"))
    )


def latest_spike(
    readings: DataFrame,
    keys: Sequence[str],
    ts: str,
    col: str,
    ties: Sequence[str],
    rows: int = 100,
    sigmas: float = 2.0,
) -> DataFrame:
    """Latest reading against mean + ``sigmas`` · std of the last ``rows`` readings."""
    stats = (
        tail_per_series(readings, keys, ts, rows, ties)
        .groupBy(*keys)
        .agg(
            F.avg(col).alias("mean"),
            F.stddev_samp(col).alias("std"),
            F.max(F.when(F.col("age") == 1, F.col(col))).alias("latest"),
        )
    )
    excess = (F.col("latest") - F.col("mean")) / F.nullif(F.col("mean"), F.lit(0.0)) * 100
    return stats.withColumns(
        {
            "is_spike": F.coalesce(F.col("latest") > F.col("mean") + F.col("std") * sigmas, F.lit(False)).cast("int"),
            "excess_pct": excess,
        }
    )


def spike_text(spikes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Location and details lines of the series that spike."""
    return spikes.filter("is_spike = 1").select(
        *keys,
        title_words(F.concat_ws(" ", *keys)).alias("location"),
        F.concat(F.lit("+"), decimal_text("excess_pct", 0), F.lit("% expected usage")).alias("details"),
    )


def flagged_sites(sites: DataFrame, spikes: DataFrame, key: str) -> DataFrame:
    """Only the sites that have a spike."""
    return sites.join(spikes.filter("is_spike = 1"), key, "left_semi")


def site_status(sites: DataFrame, spikes: DataFrame, key: str) -> DataFrame:
    """Every site: critical if it has a high-severity spike, else normal."""
    flagged = spikes.filter("is_spike = 1").select(F.col(key), F.lit(1).alias("_hit")).distinct()
    return sites.join(flagged, key, "left").withColumn(
        "status", F.when(F.col("_hit") == 1, "critical").otherwise("normal")
    ).drop("_hit")


def _period_scores(daily: DataFrame, keys: Sequence[str], date: str, cols: dict[str, str]) -> DataFrame:
    """Score per measure from the change of the last 30 rows against the 30 before."""
    recent = tail_per_series(daily, keys, date, 60)
    new, old = F.col("age") <= 30, F.col("age") > 30
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    for name, c in cols.items():
        aggs += [
            F.avg(F.when(new, F.col(c))).alias(f"_new_{name}"),
            F.avg(F.when(old, F.col(c))).alias(f"_old_{name}"),
        ]
    sums = recent.groupBy(*keys).agg(*aggs)

    def score(name: str) -> Column:
        change = (F.col(f"_old_{name}") - F.col(f"_new_{name}")) / F.nullif(F.col(f"_old_{name}"), F.lit(0.0))
        return F.when(F.col("_n") >= 60, clamp(NEUTRAL_SCORE + change * 100, 0, 100).cast("int"))

    return sums.select(*keys, *[score(n).alias(f"{n}_score") for n in cols], F.col("_n").alias("basis_days"))


def grade(score: str) -> Column:
    out = F.lit(LOWEST_GRADE)
    for limit, name in reversed(GRADES):
        out = F.when(F.col(score) >= limit, name).otherwise(out)
    return out


def gauge_colour(score: str) -> Column:
    out = F.lit(GAUGE_TOP)
    for limit, name in reversed(GAUGE):
        out = F.when(F.col(score) < limit, name).otherwise(out)
    return out


def sustainability_score(
    usage: DataFrame,
    waste: DataFrame,
    keys: Sequence[str],
    date: str,
    energy: str,
    water: str,
    diversion: str,
) -> DataFrame:
    """Weighted 0–100 score with grade, over the parts there are.

    A part without its 60 days of usage, or without waste rows, is NULL and so is its
    weighted share; the others are weighted up to a whole. ``basis_days`` are the usage
    days that were found, at most 60.
    """
    parts = _period_scores(usage, keys, date, {"energy": energy, "water": water})
    waste_score = (
        tail_per_series(waste, keys, date, 30)
        .groupBy(*keys)
        .agg(F.least(F.lit(100.0), F.avg(diversion) * 100).cast("int").alias("waste_score"))
    )
    scored = parts.join(waste_score, list(keys), "left")
    weight = sum((F.when(F.col(f"{n}_score").isNotNull(), w).otherwise(0.0) for n, w in WEIGHTS.items()), F.lit(0.0))
    weighted = {f"{n}_weighted": F.col(f"{n}_score") * w for n, w in WEIGHTS.items()}
    total = sum((F.coalesce(c, F.lit(0.0)) for c in weighted.values()), F.lit(0.0))
    known = F.col("score").isNotNull()
    return scored.withColumns({"score": total / F.nullif(F.round(weight, 9), F.lit(0.0)), **weighted}).withColumns(
        {"grade": F.when(known, grade("score")), "gauge_colour": F.when(known, gauge_colour("score"))}
    )


def score_card(scores: DataFrame, counts: DataFrame, status: DataFrame) -> DataFrame:
    """Scores with the number of active alerts by severity (``counts``: severity, alert_count) and
    ``models_ready``: whether every target of ``status`` has a trained model.

    The numbers are scalar subqueries, one row each, so nothing is joined.
    """
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("alert_count"))), F.lit(0)).cast("long")
    severities = [(f"active_{s}", F.col("severity") == s) for s in SEVERITY_ORDER[:3]]
    alerts = counts.agg(*[total(which).alias(name) for name, which in [*severities, ("active_total", F.lit(True))]])
    ready = status.groupBy("target").agg(F.bool_or(F.col("status") == "Active").alias("has"))
    ready = ready.agg(F.coalesce(F.bool_and("has"), F.lit(False)).alias("ready"))
    return scores.select(
        "*", *[alerts.select(c).scalar().alias(c) for c in alerts.columns], ready.scalar().alias("models_ready")
    )


def forecast_overage(
    forecast: DataFrame, daily: DataFrame, keys: Sequence[str], date: str, col: str
) -> DataFrame:
    """Projected total against the same number of latest actual days (``actual_30`` for the usual 30)."""
    projected = forecast.groupBy(*keys).agg(F.sum("forecast").alias("projected"), F.count_distinct(date).alias("_days"))
    longest = projected.agg(F.max("_days")).first()[0] or 0
    latest = tail_per_series(daily.select(*keys, date, col), keys, date, longest).join(projected.select(*keys, "_days"), list(keys))
    actual = latest.filter("age <= _days").groupBy(*keys).agg(F.sum(col).alias("actual_30"))
    projected = projected.drop("_days")
    pct = F.when(F.col("actual_30") > 0, (F.col("projected") - F.col("actual_30")) / F.col("actual_30") * 100).otherwise(0.0)
    text = lambda c: decimal_text(c, 0)
    return (
        projected.join(actual, list(keys), "inner")
        .withColumn("overage_pct", pct)
        .withColumn(
            "label",
            F.when(F.col("overage_pct") > 0, F.concat(F.lit("+"), text("overage_pct"), F.lit("% Overage"))).otherwise(
                F.concat(text(F.abs("overage_pct")), F.lit("% Under Budget"))
            ),
        )
    )
