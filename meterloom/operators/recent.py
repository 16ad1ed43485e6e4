"""Latest rows, latest day, month to date and trailing ranges, per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meterloom.functions.timeparts import floor_hour
from meterloom.operators.windows import whole
from meterloom.session import saved


def tail_per_series(
    df: DataFrame, keys: Sequence[str], ts: str, rows: int, ties: Sequence[str] = ()
) -> DataFrame:
    """The last ``rows`` rows of each series, with ``age`` 1 for the latest.

    Spark trims every map task to ``rows`` per key before the shuffle
    (WindowGroupLimit), so a hot key costs no more than any other.
    """
    newest = W.partitionBy(*keys).orderBy(F.desc(ts), *[F.desc(t) for t in ties])
    return df.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= rows)


def trailing_range(df: DataFrame, keys: Sequence[str], ts: str, interval: str) -> DataFrame:
    """Rows no older than ``interval`` before the series' latest, both ends included."""
    latest = F.max(ts).over(whole(keys))
    return (
        df.withColumn("_latest", latest)
        .filter(F.col(ts) >= F.col("_latest") - F.expr(f"interval {interval}"))
        .drop("_latest")
    )


def latest_day(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Rows of each series' latest day; ``df`` is a daily rollup."""
    return (
        df.withColumn("_latest", F.max(date).over(whole(keys)))
        .filter(F.col(date) == F.col("_latest"))
        .drop("_latest")
    )


def month_to_date(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Rows in the same year and month as each series' latest row."""
    return (
        df.withColumn("_latest", F.max(date).over(whole(keys)))
        .filter(month_start(date) == month_start("_latest"))
        .drop("_latest")
    )


def month_start(date) -> Column:
    return F.trunc(date, "month")


def recent_readings(df: DataFrame, keys: Sequence[str], ts: str, hours: int) -> DataFrame:
    """Readings of the last ``hours`` of each series before its latest, from the last reading of a day before their begin on.

    What a scan of the last hours needs, with the neighbour that its first gap is filled from. One
    pass over the keys and times alone leaves the last reading of every day, which says where each
    series begins; the earliest begin is a plain bound on ``ts`` that reaches the scan (folders and
    row groups before it aren't read), and a series that ended long ago does not widen the others.
    """
    days = saved(df.groupBy(*keys, F.to_date(ts).alias("_date")).agg(F.max(ts).alias("_last")), "last-of-days")
    latest = F.max("_last").over(whole(keys))
    begun = days.withColumn("_begin", floor_hour(latest) - F.expr(f"interval {hours} hours"))
    before = F.max(F.when(F.col("_date") < F.to_date("_begin"), floor_hour("_last")))
    ranges = begun.groupBy(*keys).agg(F.coalesce(before, F.min("_begin")).alias("_from"))
    first = ranges.agg(F.min("_from")).first()[0]
    rows = df if first is None else df.filter(F.col(ts) >= F.lit(first))
    near = rows.alias("x").join(ranges.alias("b"), _null_safe("x", "b", keys) & (F.col(f"x.{ts}") >= F.col("b._from")))
    return near.select("x.*")


def _null_safe(left: str, right: str, keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same
