"""Duplicates, gaps, fills and train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from meterloom.functions.timeparts import epoch_seconds
from meterloom.operators.windows import neighbours, ordered


def dedupe_keyed(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str] | None = None
) -> DataFrame:
    """One row per (keys, ts): the smallest by ``order``, then by every other column.

    An aggregate rather than a window, so duplicates fold before the shuffle and a
    hot (key, ts) never lands whole in one task.
    """
    by = [*keys, ts]
    rest = [c for c in df.columns if c not in by]
    first = [c for c in (order or []) if c in rest]
    fields = [*first, *(c for c in rest if c not in first)]
    kept = df.groupBy(*by).agg(F.min(F.struct(*fields)).alias("_kept"))
    return kept.select(*[c if c in by else F.col(f"_kept.{c}").alias(c) for c in df.columns])


def gapfill(df: DataFrame, keys: Sequence[str], ts: str, step: str = "hour", block: int | None = None) -> DataFrame:
    """Continuous range per key from its first to its last slot.

    ``ts`` must be aligned to the step and unique per key. Each row expands to the
    slots up to the next row, so no spine has to be built and joined: the one
    shuffle by key is shared with the windows that follow. ``block`` (seconds) splits
    long series over tasks, as in ``neighbours``.
    """
    one = F.expr(f"interval 1 {step}")
    row = F.col(ts)
    values = [c for c in df.columns if c not in (*keys, ts)]
    if block is None:
        spaced = df.withColumn("_until", F.lead(ts).over(ordered(keys, ts)) - one)
    else:
        spaced = neighbours(df, keys, ts, {"row": row}, block, own=False).withColumn("_until", F.col("_next_row") - one)
    stretched = spaced.withColumn(
        "_slot", F.explode(F.sequence(row, F.greatest(row, F.coalesce("_until", row)), one))
    )
    observed = F.col("_slot") == row
    return stretched.select(
        *keys,
        F.col("_slot").alias("_ts"),
        *[F.when(observed, F.col(c)).alias(c) for c in values],
        observed.alias("is_observed"),
    ).withColumnRenamed("_ts", ts)


def interpolate_linear(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], block: int | None = None
) -> DataFrame:
    """Linear interpolation over the slots; the edges take the nearest value. ``block`` as in ``neighbours``."""
    spot = df.withColumn("_pos", epoch_seconds(ts))
    point = {c: F.when(F.col(c).isNotNull(), F.struct("_pos", F.col(c).alias("v"))) for c in cols}
    found = neighbours(spot, keys, ts, point, block)

    def filled(c: str):
        before, after = f"`_prev_{c}`", f"`_next_{c}`"
        share = f"(_pos - {before}._pos) / ({after}._pos - {before}._pos)"
        between = f"{before}.v + ({after}.v - {before}.v) * ({share})"
        return F.expr(f"coalesce(`{c}`, {between}, {before}.v, {after}.v)").alias(c)

    return found.select(*[filled(c) if c in cols else F.col(c) for c in df.columns])


def fill_forward_back(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], block: int | None = None
) -> DataFrame:
    """Last known value; before the first one, the first. ``block`` as in ``neighbours``."""
    found = neighbours(df, keys, ts, {c: F.col(c) for c in cols}, block)
    return found.select(
        *[F.coalesce(f"_prev_{c}", f"_next_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def clean_hourly(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Dedupe, continuous hours, interpolation."""
    whole = gapfill(dedupe_keyed(df, keys, ts), keys, ts, "hour")
    return interpolate_linear(whole, keys, ts, cols)


def clean_daily(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Dedupe, continuous days, forward then backward fill."""
    whole = gapfill(dedupe_keyed(df, keys, ts), keys, ts, "day")
    return fill_forward_back(whole, keys, ts, cols)


def total_daily(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Daily sums over all members of a series, continuous, gaps filled forward then back.

    Members are added up before gaps are filled: a member without a row that day had
    nothing to report, while a day without any value repeats the last one.
    """
    days = df.groupBy(*keys, F.to_date(ts).alias(ts)).agg(*[F.sum(c).alias(c) for c in cols])
    return fill_forward_back(gapfill(days, keys, ts, "day").drop("is_observed"), keys, ts, cols)


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def split_train_test(df: DataFrame, date: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(rows up to the cutoff, rows after it)."""
    limit = F.lit(cutoff).cast("date")
    return df.filter(F.col(date) <= limit), df.filter(F.col(date) > limit)


def impute_median(
    df: DataFrame, train: DataFrame, keys: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Fill nulls with the training median of the key."""
    medians = train.groupBy(*keys).agg(*[F.median(c).alias(f"_med_{c}") for c in cols])
    joined = df.join(medians, list(keys), "left")
    return joined.select(
        *[F.coalesce(c, f"_med_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    )
