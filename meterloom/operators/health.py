"""Data-health profile of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from meterloom.functions.numeric import tidy


def profile(df: DataFrame, name: str, time: str, value: str) -> DataFrame:
    """One row: size, nulls, date range, mean, std and status of one measure."""
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(value).isNull()).alias("null_count"),
        F.to_date(F.min(time)).alias("first_date"),
        F.to_date(F.max(time)).alias("last_date"),
        tidy(F.avg(value), 2).alias("mean"),
        tidy(F.stddev_samp(value), 2).alias("std"),
    ).withColumn("status", F.when(F.col("null_count") == 0, "ok").otherwise("has_nulls"))


def health_report(tables: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Profiles of several (frame, name, time column, value column)."""
    return reduce(DataFrame.unionByName, [profile(*t) for t in tables])
