"""CO2e by resource from measured amounts and emission factors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Kg CO2e per unit, used where the factor table has no row.
DEFAULT_FACTORS = {
    "Electricity": 0.43,
    "Water": 0.00095,
    "Waste_Landfill": 0.544,
    "Waste_Recycled": -0.5,
}

# The factor table (resource, unit, kg CO2e per unit, source).
FACTOR_ROWS = (
    ("Electricity", "kWh", 0.43, "EPA eGRID"),
    ("Water", "Gallon", 0.00095, "EPA Water"),
    ("Waste_Landfill", "Lbs", 0.544, "EPA Waste"),
    ("Waste_Recycled", "Lbs", -0.5, "Avoided Emissions"),
    ("Gasoline", "Gallon", 8.887, "EPA Mobile"),
)


def factor_table(spark: SparkSession, without: Sequence[str] = ()) -> DataFrame:
    rows = [r for r in FACTOR_ROWS if r[0] not in without]
    return spark.createDataFrame(
        rows, "resource_type string, unit string, co2e_kg_per_unit double, source string"
    )


def co2e_by_resource(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, str], factors: DataFrame
) -> DataFrame:
    """kg CO2e per key and resource. ``measures`` maps resource type to column.

    The factor table keeps no hint: Spark broadcasts it while it is under the
    session's threshold.
    """
    pairs = ", ".join(f"'{r}', cast(`{c}` as double)" for r, c in measures.items())
    amounts = df.select(
        *keys, F.expr(f"stack({len(measures)}, {pairs}) as (resource_type, amount)")
    )
    amounts = amounts.filter(F.col("amount").isNotNull())
    totals = amounts.groupBy(*keys, "resource_type").agg(F.sum("amount").alias("amount"))
    default = F.lit(None).cast("double")
    for resource, value in DEFAULT_FACTORS.items():
        default = F.when(F.col("resource_type") == resource, value).otherwise(default)
    known = factors.select("resource_type", F.col("co2e_kg_per_unit").alias("factor"))
    return totals.join(known, "resource_type", "left").select(
        *keys,
        "resource_type",
        "amount",
        (F.col("amount") * F.coalesce("factor", default)).alias("co2e_kg"),
    )


def co2e_total(by_resource: DataFrame, keys: Sequence[str]) -> DataFrame:
    return by_resource.groupBy(*keys).agg(F.sum("co2e_kg").alias("co2e_total_kg"))
