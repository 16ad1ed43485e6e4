"""From a folder of CSV files to tables, models, forecasts and alerts."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom.operators import models
from meterloom.plans import campus
from meterloom.sources.alert_store import AlertStore

HOURS = pd.date_range("2025-01-01", "2025-04-30 23:00", freq="h")
DAYS = pd.date_range("2025-01-01", "2025-04-30", freq="D")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("campus"), np.random.default_rng(1)
    shape = 50 + 30 * np.sin(HOURS.hour / 24 * 2 * np.pi) - 20 * (HOURS.dayofweek >= 5)
    parts = []
    for name, factor in (("Gym", 1.0), ("Science_Lab", 2.0)):
        part = pd.DataFrame({"timestamp": HOURS, "building": name, "energy_kwh": shape * factor + rng.normal(0, 1, len(HOURS))})
        part["temperature_f"], part["occupancy"] = 60.0, 10
        parts.append(part)
    energy = pd.concat(parts)
    energy.loc[(energy.building == "Gym") & (energy.timestamp == HOURS[-5]), "energy_kwh"] = 2000.0
    pd.concat([energy, energy.iloc[:3]]).drop(index=100).to_csv(root / "energy_consumption.csv", index=False)
    total = 800 + 100 * (DAYS.dayofweek < 5) + rng.normal(0, 10, len(DAYS))
    waste = pd.DataFrame({"date": DAYS, "total_waste_lbs": total, "recycled_lbs": total * 0.4, "landfill_lbs": total * 0.6, "population_count": 3000})
    waste.loc[40, "total_waste_lbs"] = np.nan
    waste.to_csv(root / "waste_generation.csv", index=False)
    fuel = pd.DataFrame({"date": DAYS, "vehicle_type": np.where(DAYS.day % 2, "Van", "Bus"), "fuel_gallons": 50.0, "trips_count": 3, "miles_driven": 99.0})
    fuel.drop(index=7).to_csv(root / "transport_fuel.csv", index=False)
    (root / "emission_factors.csv").write_text("resource_type,unit,co2e_kg_per_unit,source\nElectricity,kWh,0.43,EPA eGRID\n")
    return str(root)


@pytest.fixture(scope="module")
def done(spark, folder):
    return campus.ingest_folder(spark, folder)


@pytest.fixture(scope="module")
def tables(done):
    return {n: t.cache() for n, t in campus.build_tables(done.frames).items()}


def test_missing_file_is_reported(done):
    assert list(done.errors) == ["water"] and len(done.frames) == 4


def test_tables_are_whole(tables, spark):
    assert tables["energy_hourly"].count() == len(HOURS)
    first = tables["energy_hourly"].orderBy("timestamp").first()
    assert first.energy_kwh > 100  # both buildings of the hour are in the sum
    health = {r.table_name: r for r in campus.health(tables).collect()}
    assert set(health) == {"energy_hourly", "energy_daily", "waste_daily", "transport_daily"}
    assert all(r.status == "ok" for r in health.values())
    assert health["transport_daily"].row_count == len(DAYS)
    fuel = tables["transport_daily"].filter("date = date'2025-01-08'").first()
    assert fuel.fuel_gallons == 50.0


def test_model_inputs_do_not_hold_the_target(tables):
    """A jump of one day's total moves no input of that day; the displayed mean does move."""
    days = tables["waste_daily"]
    jump = F.col("date") == F.lit("2025-04-10").cast("date")
    moved = {**tables, "waste_daily": days.withColumn("total_waste_lbs", F.when(jump, 9e6).otherwise(F.col("total_waste_lbs")))}
    inputs = lambda t: campus.model_days(t).filter(jump).select(*campus.FOREST_INPUTS).first()
    assert inputs(tables) == inputs(moved)
    later = F.col("date") == F.lit("2025-04-11").cast("date")
    mean = lambda t: campus.model_days(t).filter(later).first()["total_waste_lbs_rolling_mean_7d"]
    assert mean(moved) > 100 * mean(tables)


def test_empty_folder(spark, tmp_path):
    done = campus.ingest_folder(spark, str(tmp_path))
    tables = campus.build_tables(done.frames)
    assert not done.frames and len(done.errors) == 5 and tables == {}
    now = F.lit("2025-05-01 06:00:00").cast("timestamp_ntz")
    with pytest.raises(ValueError, match="no table to train on"):
        campus.train(tables, "2025-03-31", str(tmp_path / "m"), now)
    with pytest.raises(ValueError, match="no table to scan"):
        campus.find_alerts(tables, campus.load_models(spark, str(tmp_path / "m")))


def test_train_forecast_scan(tables, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "FOREST_TREES", 10)
    fit = models.fit_forest
    monkeypatch.setattr(models, "fit_forest", lambda train, target, inputs: fit(train, target, inputs, trees=10, depth=4))
    root, now = str(tmp_path / "models"), F.lit("2025-05-01 06:00:00").cast("timestamp_ntz")
    empty = campus.load_models(spark, root)
    assert not empty.ready
    assert {r.method for r in campus.forecast_energy(tables, empty, 3).collect()} == {"rolling_mean"}
    metrics = {r.target: r for r in campus.train(tables, "2025-03-31", root, now).collect()}
    assert set(metrics) == {"energy", "waste"} and metrics["energy"].test_days == 30
    assert metrics["waste"].top_feature in campus.FOREST_INPUTS and metrics["waste"].backend == "spark"
    assert metrics["waste"].trained_at.isoformat() == "2025-05-01T06:00:00"
    loaded = campus.load_models(spark, root)
    assert (loaded.seasonal is None) == (loaded.energy_name != "seasonal_regression")
    assert loaded.ready and loaded.energy_name == metrics["energy"].model
    for forecast in (campus.forecast_energy, campus.forecast_waste):
        rows = forecast(tables, loaded, 5).collect()
        assert len(rows) == 5 and all(r.lower <= r.forecast <= r.upper and math.isfinite(r.forecast) for r in rows)
    store = AlertStore(spark, str(tmp_path / "alerts"))
    summary = campus.scan(tables, loaded, store, now).first()
    assert summary.energy_new >= 1 and summary.new_alerts == summary.active_total
    spike = store.alerts("energy").orderBy(F.desc("sigma")).first()
    assert spike.alert_type == "phantom_load" and spike.ts == HOURS[-5].to_pydatetime()
    later = F.lit("2025-05-01 07:00:00").cast("timestamp_ntz")
    again = campus.scan(tables, loaded, store, later).first()
    assert again.new_alerts == 0 and again.active_total == summary.active_total
