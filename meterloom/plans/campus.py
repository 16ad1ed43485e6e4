"""A campus data folder, from CSV files to tables, models, forecasts and alerts.

Frames carry a ``site`` column, so several campuses may share one folder; a file
without it belongs to the site ``campus``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterloom.functions import errors
from meterloom.operators import alerts as alert_ops, clean, detect, features, forecast as fc, models
from meterloom.operators.health import health_report
from meterloom.operators.rollup import resample
from meterloom.session import saved
from meterloom.sources import csv_tables
from meterloom.sources.alert_store import AlertStore
from meterloom.sources.artifacts import load_metrics, load_model, save_metrics, save_model
from meterloom.sources.ingest import Ingested, ingest

SITE = ["site"]

# The files of a data folder.
FILES = {
    "energy": "energy_consumption.csv",
    "water": "water_consumption.csv",
    "waste": "waste_generation.csv",
    "transport": "transport_fuel.csv",
    "emission_factors": "emission_factors.csv",
}
LOADERS = {
    "energy": csv_tables.load_energy,
    "water": csv_tables.load_water,
    "waste": csv_tables.load_waste,
    "transport": csv_tables.load_transport,
    "emission_factors": csv_tables.load_emission_factors,
}

ENERGY, WATER, WASTE, FUEL = "energy_kwh", "water_gallons", "total_waste_lbs", "fuel_gallons"
POPULATION = "population_count"
FOREST_INPUTS = models.forest_features(WASTE, POPULATION)
ENERGY_REGRESSORS = ["temperature_f", "is_weekend", "is_school_session"]


def ingest_folder(spark: SparkSession, folder: str) -> Ingested:
    """Every file that can be read; the others are listed in ``errors``."""
    return ingest({n: (lambda n=n, f=f: LOADERS[n](spark, f"{folder}/{f}", keep_corrupt=True)) for n, f in FILES.items()})


def _with_site(df: DataFrame) -> DataFrame:
    return df if "site" in df.columns else df.withColumn("site", F.lit("campus"))


def build_tables(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cleaned, resampled and feature-engineered tables of the sources that loaded."""
    out: dict[str, DataFrame] = {}
    if "energy" in frames:
        by = [*SITE, "building"]
        raw = clean.clean_hourly(_with_site(frames["energy"]), by, "timestamp", [ENERGY, "temperature_f", "occupancy"])
        out |= _hourly_and_daily("energy", raw, ENERGY, "temperature_f", ["occupancy"])
    if "water" in frames:
        by = [*SITE, "zone"]
        raw = clean.clean_hourly(_with_site(frames["water"]), by, "timestamp", [WATER, "pressure_psi"])
        out |= _hourly_and_daily("water", raw, WATER, "pressure_psi", [])
    if "waste" in frames:
        optional = [c for c in ("composted_lbs",) if c in frames["waste"].columns]
        cols = [WASTE, "recycled_lbs", "landfill_lbs", POPULATION, *optional]
        days = clean.clean_daily(_with_site(frames["waste"]), SITE, "date", cols).drop("is_observed")
        out["waste_daily"] = features.waste_features(days, SITE, "date", WASTE, "recycled_lbs")
    if "transport" in frames:
        days = clean.total_daily(_with_site(frames["transport"]), SITE, "date", [FUEL, "trips_count", "miles_driven"])
        out["transport_daily"] = features.daily_features(days, SITE, "date", [FUEL])
    if "emission_factors" in frames:
        out["emission_factors"] = frames["emission_factors"]
    return out


def _hourly_and_daily(name: str, raw: DataFrame, total: str, mean: str, sums: list[str]) -> dict[str, DataFrame]:
    measures = {c: c for c in [total, *sums]}
    hours = resample(raw, SITE, "timestamp", "hour", measures, {mean: mean})
    days = resample(raw, SITE, "timestamp", "day", measures, {mean: mean}, out_ts="date")
    return {
        f"{name}_raw": raw.drop("is_observed"),
        f"{name}_hourly": features.hourly_features(hours, SITE, "timestamp", total),
        f"{name}_daily": features.daily_features(days, SITE, "date", [total], [total]),
    }


# Time and value column of each table in the health report.
HEALTH = (
    ("energy_hourly", "timestamp", ENERGY),
    ("energy_daily", "date", ENERGY),
    ("water_hourly", "timestamp", WATER),
    ("water_daily", "date", WATER),
    ("waste_daily", "date", WASTE),
    ("transport_daily", "date", FUEL),
)


def health(tables: dict[str, DataFrame]) -> DataFrame:
    return health_report([(tables[n], n, t, v) for n, t, v in HEALTH if n in tables])


# ---------------------------------------------------------------- training


@dataclass
class Models:
    """What a model folder holds; a missing model is None."""

    root: str
    energy_name: str | None = None
    energy: models.Autoregression | None = None
    seasonal: DataFrame | None = None
    waste: PipelineModel | None = None
    water: models.Autoregression | None = None
    metrics: dict[str, dict] = field(default_factory=dict)

    @property
    def ready(self) -> bool:
        return self.energy_name is not None and self.waste is not None


def model_days(tables: dict[str, DataFrame]) -> DataFrame:
    """Daily waste with the forest's inputs: the weekly mean ends the day before, so no input
    holds the day's own total. ``waste_daily`` keeps the inclusive mean for display."""
    days = features.waste_features(tables["waste_daily"], SITE, "date", WASTE, "recycled_lbs", leak_free=True)
    return days.select(*SITE, "date", WASTE, *FOREST_INPUTS)


def _errors(
    joined: DataFrame, target: str, model: str, trained_at: Column, top_feature: str | None = None
) -> DataFrame:
    return joined.agg(
        errors.mape("actual", "predicted").alias("mape"),
        errors.mae("actual", "predicted").alias("mae"),
        errors.rmse("actual", "predicted").alias("rmse"),
        F.count_distinct("date").alias("test_days"),
    ).select(
        F.lit(target).alias("target"), F.lit(model).alias("model"), "mape", "mae", "rmse", "test_days",
        trained_at.cast("timestamp_ntz").alias("trained_at"), F.lit(top_feature).cast("string").alias("top_feature"),
        F.lit("spark").alias("backend"),
    )


def _against(test: DataFrame, predicted: DataFrame, col: str) -> DataFrame:
    return predicted.select(*SITE, "date", F.col("forecast").alias("predicted")).join(
        test.select(*SITE, "date", F.col(col).alias("actual")), [*SITE, "date"]
    )


def _test_days(test: DataFrame) -> int:
    span = test.agg(F.date_diff(F.max("date"), F.min("date"))).first()[0]
    return 0 if span is None else span + 1


def _fit_ar(train: DataFrame, test: DataFrame, col: str):
    model, fitted = models.fit_autoregression(train, SITE, "date", col)
    ahead = models.forecast_autoregression(model, train, SITE, "date", col, max(1, _test_days(test)))
    return model, fitted, _against(test, ahead, col)


def train(tables: dict[str, DataFrame], cutoff: str, root: str, trained_at: Column) -> DataFrame:
    """Fit, evaluate after the cutoff and save a model per target; returns the metrics.

    Energy keeps the seasonal regression unless its MAPE exceeds the limit and the
    autoregression does better.
    """
    rows: list[DataFrame] = []
    for target, col in (("energy", ENERGY), ("water", WATER)):
        if f"{target}_daily" not in tables:
            continue
        known = clean.drop_missing_target(tables[f"{target}_daily"], col)
        days = saved(known.select(*SITE, "date", col, *(ENERGY_REGRESSORS if target == "energy" else [])), f"{target}-days")
        part, test = clean.split_train_test(days, "date", cutoff)
        if target == "energy":
            seasonal = saved(models.fit_seasonal(part, SITE, "date", col, ENERGY_REGRESSORS), "seasonal")
            ahead = models.predict_seasonal(seasonal, test, SITE, "date", ENERGY_REGRESSORS)
            best = _errors(_against(test, ahead, col), target, "seasonal_regression", trained_at)
            mape = best.first()["mape"]
            if mape is not None and mape <= fc.RETRAIN_ABOVE_MAPE:
                models.save_seasonal(seasonal, f"{root}/energy_seasonal")
                rows.append(best)
                continue
        model, fitted, compared = _fit_ar(part, test, col)
        found = _errors(compared, target, "autoregression", trained_at)
        if target == "energy" and mape is not None and not found.first()["mape"] < mape:
            models.save_seasonal(seasonal, f"{root}/energy_seasonal")
            rows.append(best)
            continue
        models.save_autoregression(fitted, model, f"{root}/{target}_autoregression")
        rows.append(found)
    if "waste_daily" in tables:
        days = saved(clean.drop_missing_target(model_days(tables), WASTE), "waste-days")
        part, test = clean.split_train_test(days, "date", cutoff)
        forest = models.fit_forest(part, WASTE, FOREST_INPUTS)
        scored = models.predict_forest(forest, test, FOREST_INPUTS, "forecast")
        weights = models.forest_importances(part.sparkSession, forest, FOREST_INPUTS)
        top = weights.orderBy(F.desc("importance"), "feature").first()["feature"]
        rows.append(_errors(_against(test, scored, WASTE), "waste", "random_forest", trained_at, top))
        save_model(forest, f"{root}/waste_forest")
    if not rows:
        raise ValueError("no table to train on: the folder had no energy, water or waste file")
    metrics = rows[0]
    for more in rows[1:]:
        metrics = metrics.unionByName(more)
    save_metrics(metrics, f"{root}/training_metrics")
    return load_metrics(metrics.sparkSession, f"{root}/training_metrics")


def load_models(spark: SparkSession, root: str) -> Models:
    """Saved models; the energy model is the one its metrics name."""
    metrics = {r["target"]: r.asDict() for r in load_metrics(spark, f"{root}/training_metrics").collect()}
    energy = metrics.get("energy", {}).get("model")
    return Models(
        root,
        energy_name=energy,
        energy=models.load_autoregression(spark, f"{root}/energy_autoregression") if energy == "autoregression" else None,
        seasonal=models.load_seasonal(spark, f"{root}/energy_seasonal") if energy == "seasonal_regression" else None,
        waste=load_model(spark, f"{root}/waste_forest"),
        water=models.load_autoregression(spark, f"{root}/water_autoregression"),
        metrics=metrics,
    )


# ---------------------------------------------------------------- forecasts


def forecast_energy(tables: dict[str, DataFrame], loaded: Models, periods: int = 7) -> DataFrame:
    days = tables["energy_daily"]
    if loaded.energy_name is None:
        return fc.forecast_flat(days, SITE, "date", ENERGY, periods, 0.10)
    if loaded.energy is not None:
        return models.forecast_autoregression(loaded.energy, days, SITE, "date", ENERGY, periods)
    future = fc.future_regressors(days, SITE, "date", "temperature_f", periods)
    return models.predict_seasonal(loaded.seasonal, future, SITE, "date", ENERGY_REGRESSORS)


def forecast_water(tables: dict[str, DataFrame], loaded: Models, periods: int = 7) -> DataFrame:
    days = tables["water_daily"]
    if loaded.water is None:
        return fc.forecast_seasonal_rolling(days, SITE, "date", WATER, periods)
    return models.forecast_autoregression(loaded.water, days, SITE, "date", WATER, periods)


def forecast_waste(tables: dict[str, DataFrame], loaded: Models, periods: int = 7) -> DataFrame:
    days = tables["waste_daily"]
    if loaded.waste is None:
        return fc.forecast_flat(days, SITE, "date", WASTE, periods, models.FOREST_MARGIN)
    return models.forecast_forest(loaded.waste, days, SITE, "date", WASTE, POPULATION, periods)


def predicted_energy_hours(tables: dict[str, DataFrame], loaded: Models) -> DataFrame:
    """Actual and predicted kWh per hour."""
    hours, days = tables["energy_hourly"], tables["energy_daily"]
    if loaded.energy_name is None:
        return fc.disaggregate_hourly(hours, None, None, SITE, "timestamp", ENERGY)
    if loaded.energy is not None:
        yhat = models.backcast_autoregression(loaded.energy, days, SITE, "date", ENERGY)
        yhat = yhat.withColumnRenamed("predicted", "yhat")
    else:
        yhat = models.predict_seasonal(loaded.seasonal, days, SITE, "date", ENERGY_REGRESSORS)
        yhat = yhat.withColumnRenamed("forecast", "yhat")
    profile = fc.hourly_profile(hours, SITE, "timestamp", ENERGY)
    return fc.disaggregate_hourly(hours, yhat, profile, SITE, "timestamp", ENERGY)


# ---------------------------------------------------------------- alerts


def find_alerts(tables: dict[str, DataFrame], loaded: Models) -> DataFrame:
    """All detectors over their scan ranges, for the tables there are."""
    found: list[DataFrame] = []
    if "energy_hourly" in tables:
        found.append(detect.detect_energy(predicted_energy_hours(tables, loaded), SITE, "timestamp", ENERGY))
    if "water_hourly" in tables:
        roles = {WATER: "flow", "pressure_psi": "pressure"}
        found.append(detect.detect_water(tables["water_hourly"], SITE, "timestamp", roles))
    if "waste_daily" in tables and loaded.waste is not None:
        scored = models.predict_forest(loaded.waste, model_days(tables), FOREST_INPUTS).select(
            *SITE, "date", F.col(WASTE).alias("actual"), "predicted", F.lit("random_forest").alias("method")
        )
        found.append(detect.detect_waste(scored, SITE, "date", WASTE))
    if not found:
        raise ValueError("no table to scan: the folder had no energy, water or waste file")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def scan(tables: dict[str, DataFrame], loaded: Models, store: AlertStore, now: Column) -> DataFrame:
    """Find alerts, append the new ones, and summarise the store."""
    store.add(find_alerts(tables, loaded), now)
    state = store.state()
    return alert_ops.scan_summary(state.filter(F.col("created_at") == now.cast("timestamp_ntz")), state)
