"""Calendar, lag, rolling and smoothing features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterloom.functions.numeric import safe_ratio
from meterloom.functions.timeparts import calendar_columns
from meterloom.operators.windows import ALL_ROWS, centered, from_here, ordered, so_far, trailing, whole

# Lags and windows of the feature set.
HOURLY_LAGS = (1, 24, 168)
HOURLY_MEANS = (3, 24)
DAILY_LAGS = (1, 7)
DAILY_MEAN = 7
SMOOTH_HOURLY = 3
SMOOTH_DAILY = 7


def add_calendar(df: DataFrame, ts: str, hourly: bool) -> DataFrame:
    return df.withColumns(calendar_columns(ts, hourly))


def hourly_lag_columns(keys: Sequence[str], ts: str, col: str) -> dict[str, Column]:
    """Lags that fall back to the trailing day's mean, and trailing means."""
    day = F.avg(col).over(trailing(keys, ts, 24))
    cols = {
        f"{col}_lag_{n}h": F.coalesce(F.lag(col, n).over(ordered(keys, ts)), day)
        for n in HOURLY_LAGS
    }
    for n in HOURLY_MEANS:
        cols[f"{col}_rolling_mean_{n}h"] = F.avg(col).over(trailing(keys, ts, n))
    return cols


def daily_lag_columns(
    keys: Sequence[str], ts: str, col: str, leak_free: bool = False
) -> dict[str, Column]:
    """Lags that fall back to the trailing week's mean.

    The trailing mean includes the current day, so as a model input it contains
    its own target; ``leak_free=True`` ends the mean on the day before.
    """
    week = F.avg(col).over(trailing(keys, ts, DAILY_MEAN, include_current=not leak_free))
    cols = {
        f"{col}_lag_{n}d": F.coalesce(F.lag(col, n).over(ordered(keys, ts)), week)
        for n in DAILY_LAGS
    }
    cols[f"{col}_rolling_mean_{DAILY_MEAN}d"] = week
    return cols


def smooth(keys: Sequence[str], ts: str, col: str, rows: int) -> Column:
    """Centered mean; at the edges over the rows there are."""
    return F.avg(col).over(centered(keys, ts, rows))


def hourly_features(df: DataFrame, keys: Sequence[str], ts: str, col: str) -> DataFrame:
    cols = calendar_columns(ts, True) | hourly_lag_columns(keys, ts, col)
    return df.withColumns(cols | {f"{col}_smoothed": smooth(keys, ts, col, SMOOTH_HOURLY)})


def daily_features(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    lagged: Sequence[str],
    smoothed: Sequence[str] = (),
    leak_free: bool = False,
) -> DataFrame:
    cols = calendar_columns(ts, False)
    for c in lagged:
        cols |= daily_lag_columns(keys, ts, c, leak_free)
    for c in smoothed:
        cols[f"{c}_smoothed"] = smooth(keys, ts, c, SMOOTH_DAILY)
    return df.withColumns(cols)


def waste_features(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    total: str,
    recycled: str,
    leak_free: bool = False,
) -> DataFrame:
    """Daily features of total and recycled, plus the diversion rate."""
    out = daily_features(df, keys, ts, [total, recycled], [total], leak_free)
    return out.withColumn("diversion_rate", safe_ratio(recycled, total))


#: Frames up to this many rows are summed anew for every row; longer ones by blocks.
SHORT_FRAME = 32


def rolling_stats(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    col: str,
    rows: int,
    at_least: int,
    mean: str | None = None,
    std: str | None = None,
) -> DataFrame:
    """Trailing mean and std as the columns named, NULL until ``at_least`` values are there.

    The cost of a long frame does not grow with its length: a series is cut into blocks as long
    as the frame, so a frame is the end of one block and the beginning of the next. Both are
    running sums of deviations from a value of their own block, and the two are put together
    as the parts of a variance are. Nothing is subtracted that was added far away, so the
    result is as near as that of a frame summed on its own, and a frame of equal values has std 0.
    """
    if rows <= SHORT_FRAME:
        frame = trailing(keys, ts, rows)
        stats = {mean: F.avg(col).over(frame), std: F.stddev_samp(col).over(frame)}
        wanted = {name: stat for name, stat in stats.items() if name}
        found = df.withColumns({"_n": F.count(col).over(frame), **wanted})
        enough = F.col("_n") >= at_least
        return found.withColumns({name: F.when(enough, F.col(name)) for name in wanted}).drop("_n")

    series, block = [*keys], [*keys, "_frame"]
    value = F.col(col).cast("double")
    dev = value - F.col("_base")

    def sums(frame) -> Column:
        parts = {"n": F.count(value), "s": F.sum(dev), "q": F.sum(dev * dev), "lo": F.min(value), "hi": F.max(value)}
        return F.struct(F.col("_base").alias("b"), *[p.over(frame).alias(n) for n, p in parts.items()])

    placed = df.withColumn("_at", F.row_number().over(ordered(series, ts)) - 1).withColumn("_frame", F.expr(f"_at div {rows}"))
    back = Window.partitionBy(*block).orderBy(F.desc(ts))
    based = placed.withColumn("_base", F.first(value, True).over(back.rowsBetween(*ALL_ROWS)))
    ends = based.withColumn("_end", sums(back.rowsBetween(Window.unboundedPreceding, 0)))
    begun = ends.withColumn("_begin", sums(so_far(block, ts)))
    # In the order of (block, time), so the rows need no further sort.
    earlier = F.lag("_end", rows - 1).over(Window.partitionBy(*series).orderBy("_frame", ts))
    both = begun.withColumn("_end", F.when(F.col("_at") % rows != rows - 1, earlier))

    def part(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}.{name}"), F.lit(0.0))

    n1, n2 = part("_begin", "n"), part("_end", "n")
    n = n1 + n2
    mean1, mean2 = (F.col(f"{s}.b") + part(s, "s") / F.nullif(part(s, "n"), F.lit(0.0)) for s in ("_begin", "_end"))
    gap = F.coalesce(mean2 - mean1, F.lit(0.0))
    inner = [part(s, "q") - F.coalesce(part(s, "s") * part(s, "s") / F.nullif(part(s, "n"), F.lit(0.0)), F.lit(0.0)) for s in ("_begin", "_end")]
    share = n2 / F.nullif(n, F.lit(0.0))
    square = inner[0] + inner[1] + gap * gap * n1 * share
    flat = F.least("_begin.lo", "_end.lo") == F.greatest("_begin.hi", "_end.hi")
    found = {
        mean: F.coalesce(mean1 + gap * share, mean2),
        std: F.when(n > 1, F.when(flat, 0.0).otherwise(F.sqrt(F.greatest(square, F.lit(0.0)) / (n - 1)))),
    }
    enough = n >= at_least
    out = both.withColumns({name: F.when(enough, stat) for name, stat in found.items() if name})
    return out.drop("_at", "_frame", "_base", "_begin", "_end")


def backfill_std(
    df: DataFrame, keys: Sequence[str], ts: str, std: str, series_col: str | None = None
) -> DataFrame:
    """A missing std takes the next one known; then, if asked, the std of the series."""
    fill = F.last(std, True).over(from_here(keys, ts))
    if series_col:
        fill = F.coalesce(fill, F.stddev_samp(series_col).over(whole(keys)))
    return df.withColumn(std, fill)


def trailing_baseline(keys: Sequence[str], ts: str, col: str, reach: int = 7) -> Column:
    """Mean of the current row and the ``reach`` rows before it."""
    return F.avg(col).over(trailing(keys, ts, reach + 1))


def lag_vector(
    df: DataFrame, keys: Sequence[str], ts: str, col: str, steps: int = 14, out: str = "lags"
) -> DataFrame:
    """The ``steps`` values before each row, oldest first; rows without them go."""
    frame = ordered(keys, ts).rowsBetween(-steps, -1)
    return df.withColumn(out, F.collect_list(col).over(frame)).filter(F.size(out) == steps)
