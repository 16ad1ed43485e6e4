"""CSV scans, ingest reports, metrics files."""

import pytest
from pyspark.sql import functions as F

from meterloom import schemas
from meterloom.sources import artifacts, csv_tables
from meterloom.sources.ingest import ingest


def write(path, text):
    path.write_text(text)
    return str(path)


def test_waste_with_blanks_and_optional_compost(spark, tmp_path):
    plain = write(tmp_path / "w.csv", "date,total_waste_lbs,recycled_lbs,landfill_lbs,population_count\n2025-03-05,10.5,4,6.5,300\n2025-03-06,,3,5,200\n")
    df = csv_tables.load_waste(spark, plain)
    assert [r.total_waste_lbs for r in df.orderBy("date").collect()] == [10.5, None]
    assert "composted_lbs" not in df.columns
    extra = write(tmp_path / "x.csv", "date,total_waste_lbs,recycled_lbs,landfill_lbs,population_count,composted_lbs\n2025-03-05,10.5,4,6.5,300,1.5\n")
    assert csv_tables.load_waste(spark, extra).first().composted_lbs == 1.5


def test_columns_are_taken_by_name(spark, tmp_path):
    path = write(tmp_path / "e.csv", "note,temperature_f,energy_kwh,building,timestamp,occupancy\nx,70,500,Gym,2025-01-01 00:00:00,3\n")
    row = csv_tables.load_energy(spark, path).first()
    assert (row.energy_kwh, row.temperature_f, row.building, row.occupancy) == (500.0, 70.0, "Gym", 3)
    assert "note" not in row.asDict()
    with pytest.raises(ValueError, match="pressure_psi"):
        csv_tables.load_water(spark, write(tmp_path / "w.csv", "timestamp,zone,water_gallons\n2025-01-01 00:00:00,a,1\n"))


def test_corrupt_rows_are_counted(spark, tmp_path):
    path = write(tmp_path / "f.csv", "source,resource_type,unit,co2e_kg_per_unit\nEPA,Water,Gallon,0.00095\nEPA,Gas,Gallon,many\n")
    done = ingest({"factors": lambda: csv_tables.load_emission_factors(spark, path, keep_corrupt=True), "bad": lambda: csv_tables.load_water(spark, path)})
    assert (done.rows, done.corrupt, list(done.errors)) == ({"factors": 2}, {"factors": 1}, ["bad"])
    assert "_corrupt" not in done.frames["factors"].columns
    assert csv_tables.corrupt_rows(spark, path, schemas.EMISSION_FACTORS).first().resource_type == "Gas"


def test_nan_becomes_null(spark, tmp_path):
    path = write(tmp_path / "e.csv", "timestamp,building,energy_kwh,temperature_f,occupancy\n2025-01-01 00:00:00,Gym,NaN,50,3\n")
    row = csv_tables.load_energy(spark, path).first()
    assert row.energy_kwh is None and row.temperature_f == 50.0


def test_corrupt_rows_are_kept_aside(spark, tmp_path):
    path = write(tmp_path / "f.csv", "resource_type,unit,co2e_kg_per_unit,source\nWater,Gallon,0.00095,EPA Water\nGas,Gallon,many,EPA\n")
    df = csv_tables.read_csv(spark, path, schemas.EMISSION_FACTORS, keep_corrupt=True).cache()
    assert df.filter(F.col("_corrupt").isNotNull()).count() == 1
    assert csv_tables.load_emission_factors(spark, path).count() == 2


def test_ingest_goes_on_after_a_failure(spark, tmp_path):
    good = write(tmp_path / "f.csv", "resource_type,unit,co2e_kg_per_unit,source\nWater,Gallon,0.00095,EPA Water\n")
    done = ingest(
        {
            "missing": lambda: csv_tables.load_energy(spark, str(tmp_path / "none.csv")),
            "factors": lambda: csv_tables.load_emission_factors(spark, good),
        }
    )
    assert not done.ok and list(done.frames) == ["factors"] and done.rows == {"factors": 1}
    report = {r.source: r.status for r in done.report(spark).collect()}
    assert report == {"missing": "failed", "factors": "loaded"}


def test_metrics_and_models_that_were_never_saved(spark, tmp_path):
    assert artifacts.load_metrics(spark, str(tmp_path / "m")).count() == 0
    assert artifacts.load_model(spark, str(tmp_path / "none")) is None
