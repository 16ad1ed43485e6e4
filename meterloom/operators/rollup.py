"""Hourly and daily rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterloom.functions.timeparts import floor_hour
from meterloom.operators.clean import gapfill


def rollup(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step: str,
    sums: Mapping[str, str | Column],
    means: Mapping[str, str | Column] | None = None,
    out_ts: str | None = None,
) -> DataFrame:
    """Sums and means per key and time slot, for slots that have readings.

    A sum over nothing but nulls is 0 and a mean over them NULL.
    """
    slot = floor_hour(ts) if step == "hour" else F.to_date(ts)
    measures = [F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in sums.items()]
    measures += [F.avg(c).alias(n) for n, c in (means or {}).items()]
    return df.groupBy(*keys, slot.alias(out_ts or ts)).agg(*measures)


def resample(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step: str,
    sums: Mapping[str, str | Column],
    means: Mapping[str, str | Column] | None = None,
    out_ts: str | None = None,
) -> DataFrame:
    """Rollup on a continuous range: empty slots sum to 0 and have no mean."""
    out = out_ts or ts
    slots = gapfill(rollup(df, keys, ts, step, sums, means, out), keys, out, step)
    return slots.drop("is_observed").fillna(0.0, subset=list(sums))


#: Rows that a task of ``with_distinct`` folds; its memory is that of so many groups at most.
ROWS_A_TASK = 1_250_000


def with_distinct(df: DataFrame, by: Mapping[str, Column], measures: Mapping[str, Column], key: str, name: str) -> DataFrame:
    """Sums of ``measures`` per group, and the exact number of different integer keys as ``name``.

    Keys become bits of one long per group and run of 64 keys. Where keys are spread over the groups
    at random nothing folds in the map tasks, which would hold every row of their file split, so rows
    move first: by group and run, to as many tasks as there are ``ROWS_A_TASK`` rows. ``df`` is counted
    for that, which reads no more than the footers of a Parquet table. Null keys don't count.
    """
    number = F.col(key).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
    rows = df.select(
        *[c.alias(n) for n, c in by.items()], F.shiftright(number, 6).alias("_run"), bit.alias("_bit"),
        *[c.alias(n) for n, c in measures.items()],
    )
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS_A_TASK + 1)
    parts = rows.repartition(tasks, *by, "_run").groupBy(*by, "_run").agg(
        *[F.sum(n).alias(n) for n in measures], F.bit_or("_bit").alias("_keys")
    )
    found = F.bit_count("_keys")  # of no key at all: null
    return parts.groupBy(*by).agg(*[F.sum(n).alias(n) for n in measures], F.coalesce(F.sum(found), F.lit(0)).cast("double").alias(name))
