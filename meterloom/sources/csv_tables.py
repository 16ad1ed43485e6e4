"""CSV scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from meterloom import schemas
from meterloom.functions.numeric import nan_to_null
from meterloom.functions.timeparts import iso_text

CORRUPT = "_corrupt"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False, optional: T.StructType | None = None
) -> DataFrame:
    """Rows of a CSV table, columns taken by header name; NaN becomes NULL.

    A column of ``schema`` that the header lacks is an error; columns of ``optional`` are
    kept where there are any, others are left out. Nothing is sorted: order lives in the
    windows. ``keep_corrupt`` adds the raw text of rows that do not fit the schema.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    kinds = {f.name: f for f in [*schema.fields, *(optional.fields if optional else [])]}
    in_file = [kinds.get(c, T.StructField(c, T.StringType())) for c in header]
    full = T.StructType([*in_file, *[T.StructField(CORRUPT, T.StringType())] * keep_corrupt])
    reader = spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE")
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    wanted = [f.name for f in schema.fields] + [c for c in header if c in kinds and c not in schema.names]
    df = reader.csv(path).select(*wanted, *[CORRUPT] * keep_corrupt)
    clean = {c: nan_to_null(c) for c in wanted if isinstance(kinds[c].dataType, T.DoubleType)}
    return df.withColumns(clean)


def corrupt_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Raw text of the rows that do not fit the schema. All columns are read: a row that
    is only counted isn't parsed."""
    rows = read_csv(spark, path, schema, keep_corrupt=True)
    return rows.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT, *schema.names)


def load_energy(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, schemas.ENERGY, **options)


def load_water(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, schemas.WATER, **options)


COMPOST = T.StructType([T.StructField("composted_lbs", T.DoubleType())])


def load_waste(spark: SparkSession, path: str, **options) -> DataFrame:
    """Daily waste; a ``composted_lbs`` column is kept if the header has one."""
    return read_csv(spark, path, schemas.WASTE, optional=COMPOST, **options)


def load_transport(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, schemas.TRANSPORT, **options)


def load_emission_factors(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, schemas.EMISSION_FACTORS, **options)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; clock times as ISO text, whatever the session time zone."""
    stamps = {
        f.name: iso_text(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    df.withColumns(stamps).write.mode("errorifexists").option("header", True).csv(path)
