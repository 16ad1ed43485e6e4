"""Window specs and time-block splitting for very long series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.window import WindowSpec

from meterloom.functions.timeparts import epoch_seconds


ALL_ROWS = (W.unboundedPreceding, W.unboundedFollowing)


def ordered(keys: Sequence[str], ts: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(ts)


def trailing(keys: Sequence[str], ts: str, rows: int, include_current: bool = True) -> WindowSpec:
    """The last ``rows`` rows, ending at the current row or just before it."""
    if include_current:
        return ordered(keys, ts).rowsBetween(-(rows - 1), 0)
    return ordered(keys, ts).rowsBetween(-rows, -1)


def centered(keys: Sequence[str], ts: str, rows: int) -> WindowSpec:
    return ordered(keys, ts).rowsBetween(-(rows // 2), rows // 2)


def so_far(keys: Sequence[str], ts: str) -> WindowSpec:
    return ordered(keys, ts).rowsBetween(W.unboundedPreceding, 0)


def from_here(keys: Sequence[str], ts: str) -> WindowSpec:
    """Rows from the current one to the end, as a descending running frame.

    Written descending because Spark evaluates an UNBOUNDED FOLLOWING frame anew
    for every row (quadratic), and a running frame once. ``last(x, ignorenulls)``
    over it is the nearest value at or after the row.
    """
    return W.partitionBy(*keys).orderBy(F.desc(ts)).rowsBetween(W.unboundedPreceding, 0)


def whole(keys: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys)


def in_time_blocks(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    fn: Callable[[DataFrame, Sequence[str]], DataFrame],
    block: int,
    before: int,
    after: int = 0,
) -> DataFrame:
    """Run a bounded-frame window operator on pieces of each series in parallel.

    ``slot`` is an integer time slot of a gap-free series. Each row goes to its
    own block and, as halo, to the next block if within ``before`` slots of it and
    to the previous one if within ``after``. ``fn(frame, keys)`` sees the block as
    one more key; halo rows are dropped afterwards. Results equal the unsplit ones
    for any frame of at most ``before`` preceding and ``after`` following rows, and
    one series no longer has to fit in one task.
    """
    if before > block or after > block:
        raise ValueError("a block must be at least as long as its halo")
    home = F.floor(F.col(slot) / block)
    offset = F.col(slot) - home * block
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= block - before, home + 1),
            F.when(offset < after, home - 1),
        )
    )
    spread = df.withColumn("_home", home).withColumn("_block", F.explode(copies))
    out = fn(spread, [*keys, "_block"])
    return out.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")


def neighbours(
    df: DataFrame, keys: Sequence[str], ts: str, points: Mapping[str, Column], block: int | None = None, own: bool = True
) -> DataFrame:
    """``_prev_<name>`` and ``_next_<name>``: the nearest point of each name before a row and after it.

    A point is a value of any type; where it is NULL there is none. A row's ``own`` point counts
    on both sides, or on none. The descending half runs first, so the rows end up in time order
    and later windows need no sort of their own.

    ``block`` (seconds) cuts each series at fixed times, so that one long series is the work of
    many tasks: the first and last point of every block are found first (one row a block), then carried over the blocks of a series, and come back to each block as an extra row at
    either end. ``df`` is read twice then; store it if it is dear.
    """
    near = (W.unboundedPreceding, 0 if own else -1)
    if block is None:
        series = W.partitionBy(*keys)
        after = {f"_next_{n}": F.last(p, True).over(series.orderBy(F.desc(ts)).rowsBetween(*near)) for n, p in points.items()}
        before = {f"_prev_{n}": F.last(p, True).over(series.orderBy(ts).rowsBetween(*near)) for n, p in points.items()}
        return df.withColumns(after).withColumns(before)
    home = F.floor(epoch_seconds(ts) / block)
    spots = df.withColumns({**{f"_at_{n}": p for n, p in points.items()}, "_cell": home, "_side": F.lit(1)})
    known = {n: F.when(F.col(f"_at_{n}").isNotNull(), F.struct(F.col(ts), F.col(f"_at_{n}").alias("p"))) for n in points}
    ends = spots.groupBy(*keys, "_cell").agg(
        *[F.min(k).alias(f"_first_{n}") for n, k in known.items()], *[F.max(k).alias(f"_last_{n}") for n, k in known.items()]
    )
    earlier = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(
        *keys, "_cell",
        *[F.last(f"_first_{n}", True).over(later)["p"].alias(f"_on_{n}") for n in points],
        *[F.last(f"_last_{n}", True).over(earlier)["p"].alias(f"_back_{n}") for n in points],
    )

    def extra(side: int, kind: str) -> DataFrame:
        return ends.select(*keys, "_cell", F.lit(side).alias("_side"), *[F.col(f"_{kind}_{n}").alias(f"_at_{n}") for n in points])

    rows = spots.unionByName(extra(0, "back"), True).unionByName(extra(2, "on"), True)
    rows = rows.repartition(*keys, "_cell")  # rows that are dealt by series alone would stay so
    part = W.partitionBy(*keys, "_cell")
    down, up = (part.orderBy(*order).rowsBetween(*near) for order in ([F.desc("_side"), F.desc(ts)], ["_side", ts]))
    rows = rows.withColumns({f"_next_{n}": F.last(f"_at_{n}", True).over(down) for n in points})
    rows = rows.withColumns({f"_prev_{n}": F.last(f"_at_{n}", True).over(up) for n in points})
    return rows.filter("_side = 1").drop("_cell", "_side", *[f"_at_{n}" for n in points])
