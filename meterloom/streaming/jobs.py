"""Incremental rollup, alert de-duplication and periodic scans.

Every job takes a streaming frame of readings, a target folder and a checkpoint
folder, and runs with ``availableNow`` until its input is used up; started again with
the same checkpoint it takes up where it stopped. A target belongs to one checkpoint.

No job keeps watermarked state: a batch publishes what it adds under its number, and
readers merge. So no reading is late, files may come in any order and any number a batch,
and a repeated batch that is published already adds nothing. Full levels of batches are
folded into one as the job goes on, so n batches leave about log n folders.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from meterloom.functions.timeparts import floor_hour
from meterloom.operators.clean import gapfill, interpolate_linear
from meterloom.operators.detect import HOURLY_ROWS
from meterloom.session import saved
from meterloom.sources.alert_store import AlertStore
from meterloom.sources.batch_log import FANOUT, BatchLog


def read_readings(spark: SparkSession, table: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    """A table of readings, one Parquet file or a folder of part files, as a stream.

    The last letter is a glob of one letter: a stream takes a glob that names a file,
    but not the file itself.
    """
    name = table.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{name[:-1]}[{name[-1]}]")


def _run(frame: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    query = (
        frame.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


def _log(spark: SparkSession, target: str) -> BatchLog:
    return BatchLog(spark, target, ("date",))


def _part_names(cols: Sequence[str]) -> list[str]:
    return ["rows", *(f"{c}_{k}" for c in cols for k in ("sum", "n"))]


def _partials(batch: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Per hour: rows, and sum and number of the known values of each column."""
    parts = [a for c in cols for a in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]
    hours = batch.groupBy(*keys, floor_hour(ts).alias(ts)).agg(F.count(F.lit(1)).alias("rows"), *parts)
    return hours.withColumn("date", F.to_date(ts))


def _added(partials: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return partials.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _part_names(cols)])


def _merged(partials: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    means = [(F.col(f"{c}_sum") / F.nullif(f"{c}_n", F.lit(0))).alias(f"{c}_mean") for c in cols]
    return _added(partials, [*keys, ts], cols).select(*keys, ts, "rows", *[f"{c}_sum" for c in cols], *means)


def hourly_rollup(
    readings: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], target: str, checkpoint: str, fanout: int = FANOUT
) -> None:
    """Every batch adds its sums per key and hour; ``read_rollup`` adds them up."""
    log = _log(readings.sparkSession, target)

    def each(batch: DataFrame, number: int) -> None:
        log.append(_partials(batch, keys, ts, cols), number)
        log.merge(lambda p: _added(p, [*keys, ts, "date"], cols), fanout)

    _run(readings, checkpoint, each)


def read_rollup(spark: SparkSession, target: str, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Hours over all batches: keys, time, ``rows``, and ``_sum`` and ``_mean`` of each column."""
    return _merged(_log(spark, target).read(), keys, ts, cols)


def compact_rollup(spark: SparkSession, source: str, target: str, keys: Sequence[str], ts: str, cols: Sequence[str]) -> None:
    """All batches of ``source`` as the one batch of a new target."""
    _log(spark, target).append(_added(_log(spark, source).read(), [*keys, ts, "date"], cols))


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    """Equal columns, nulls too."""
    out = F.lit(True)
    for c in cols:
        out = out & left[c].eqNullSafe(right[c])
    return out


def first_per_bucket(readings: DataFrame, keys: Sequence[str], ts: str, target: str, checkpoint: str, fanout: int = FANOUT) -> None:
    """One row per key and hour, whenever its readings come. A batch is compared with the stored rows of its own dates."""
    log = _log(readings.sparkSession, target)

    def each(batch: DataFrame, number: int) -> None:
        unique = batch.select(*keys, floor_hour(ts).alias("bucket")).distinct().withColumn("date", F.to_date("bucket"))
        stored = log.read()
        if stored is not None:
            first, last = unique.agg(F.min("date"), F.max("date")).first()
            near = stored.filter(F.col("date").between(first, last))
            unique = unique.join(near, on=_same(unique, near, [*keys, "bucket"]), how="left_anti")
        log.append(unique, number)
        log.merge(lambda rows: rows, fanout)

    _run(readings, checkpoint, each)


def read_buckets(spark: SparkSession, target: str) -> DataFrame:
    return _log(spark, target).read().drop("date")


Detector = Callable[[DataFrame], DataFrame]


def scan_into_store(
    readings: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    measures: Mapping[str, Column],
    detector: Detector,
    history: str,
    store: AlertStore,
    checkpoint: str,
    now: Column,
    resource: str,
    lookback: int = HOURLY_ROWS,
    fanout: int = FANOUT,
) -> None:
    """Take in all new readings, then scan the hours they can have changed anew.

    Batches add partial sums, the first and last hour of each day, and per series the hours
    they touched. One scan follows when the input is used up, over closed hours (before the
    hour of ``now``): of every series, the hours whose alerts can differ from what was said of
    them before, with the history that the detector's frames need. Its verdict replaces the
    earlier one in the store: new alerts are added, changed ones corrected, those that more
    readings have disproved are withdrawn; status changes made meanwhile stay. So the store
    holds what one scan of all readings would find, however they were split into runs, files
    and batches. Touched hours stay on the list until a scan has covered them: a broken scan
    is repeated, and an open hour waits for the run after its end.

    ``measures`` are formed from the columns of ``read_rollup``. The ``detector`` gives alerts of
    ``resource``; its verdict on an hour may depend on ``lookback`` hours before it and, where a
    rolling std is unknown or zero, on the next one known.
    """
    spark = readings.sparkSession
    sums, days, touched = _log(spark, f"{history}/sums"), BatchLog(spark, f"{history}/days"), BatchLog(spark, f"{history}/touched")
    known = F.lit(True)
    for c in cols:
        known = known & (F.col(f"{c}_n") > 0)
    bounds = {"first": F.min, "last": F.max, "known_first": F.min, "known_last": F.max}

    def each(batch: DataFrame, number: int) -> None:
        if touched.manifest().mark >= number:
            return
        sums.append(_partials(batch, keys, ts, cols), number)
        own = sums.read([f"{number:010d}"])
        spots = {"first": ts, "last": ts, "known_first": F.when(known, F.col(ts)), "known_last": F.when(known, F.col(ts))}
        days.append(own.groupBy(*keys, "date").agg(*[f(spots[n]).alias(n) for n, f in bounds.items()]), number)
        touched.append(own.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")), number)
        sums.merge(lambda p: _added(p, [*keys, ts, "date"], cols), fanout)
        days.merge(lambda d: d.groupBy(*keys, "date").agg(*[f(n).alias(n) for n, f in bounds.items()]), fanout)

    _run(readings, checkpoint, each)
    pending = touched.manifest()
    spans = touched.read(manifest=pending)
    if spans is None or not pending.batches:
        return
    closes = floor_hour(now)
    spans = saved(spans.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "touched-hours")
    closed = spans.filter(F.col("lo") < closes).withColumn("hi", F.least("hi", closes - F.expr("interval 1 hour")))
    if not closed.isEmpty():
        _scan(sums.read(), days.read(), closed, keys, ts, cols, measures, detector, store, now, resource, lookback)
    still = spans.filter(F.col("hi") >= closes).withColumn("lo", F.greatest("lo", closes))
    if not still.isEmpty():
        touched.append(still)
    touched.drop([name for name, _ in pending.batches])


def _ranges(days: DataFrame, closed: DataFrame, keys: Sequence[str], closes: Column, lookback: int) -> DataFrame:
    """keys, start, end, lo, hi, from, to: per series its own bounds, the hours whose verdict can have
    changed, and the hours to read for them.

    A reading changes its hour, the gap around it up to hours on other days that have all values, and
    what looks back on those. Within ``lookback`` of its start all of a series changes before it: the
    first rows take the first std there is. ``days`` has a row per series and day.
    """
    span = F.expr(f"interval {lookback} hours")
    own = days.filter(F.col("first") < closes).alias("d")

    def met(right: DataFrame, *more: str) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}"))
        joined = own.join(right.alias("r"), same)
        return joined.groupBy(*[F.col(f"r.{c}").alias(c) for c in (*keys, *more)])

    def before(at: str) -> Column:
        return F.max(F.when(F.col("d.date") < F.to_date(F.col(at)), F.col("d.known_last")))

    def after(at: str) -> Column:
        there = (F.col("d.date") > F.to_date(F.col(at))) & (F.col("d.known_first") < closes)
        return F.min(F.when(there, F.col("d.known_first")))

    last = F.least(F.max("d.last"), closes - F.expr("interval 1 hour"))
    spans = met(closed, "lo", "hi").agg(F.min("d.first").alias("start"), last.alias("end"), before("r.lo").alias("_b"), after("r.hi").alias("_a"))
    begin = F.when(F.col("lo") <= F.col("start") + span, F.col("start")).otherwise(F.coalesce("_b", "start"))
    spans = spans.select(*keys, "start", "end", begin.alias("lo"), F.least(F.coalesce("_a", "end") + span, F.col("end")).alias("hi"))
    spans = saved(spans.withColumn("reach", F.col("lo") - span), "scan-hours")
    found = met(spans, "start", "end", "lo", "hi", "reach").agg(before("r.reach").alias("_b"), after("r.hi").alias("_a"))
    return found.select(*keys, "start", "end", "lo", "hi", F.coalesce("_b", "start").alias("from"), F.coalesce("_a", "end").alias("to"))


def _scan(partials, days, closed, keys, ts, cols, measures, detector, store, now, resource, lookback) -> None:
    """The detector over the hours whose verdict can have changed; the store takes its word for them."""
    closes = floor_hour(now)
    span = F.expr(f"interval {lookback} hours")
    ranges = saved(_ranges(days, closed, keys, closes, lookback), "scan-ranges")

    def formed(ranges: DataFrame) -> DataFrame:
        """Hours of the ranges; ``date`` bounds prune the folders where no series looks."""
        first, final = ranges.agg(F.to_date(F.min("from")), F.to_date(F.max("to"))).first()
        own = partials.filter(F.col("date").between(first, final) & (F.col(ts) < closes))
        inside = _same(own, ranges, keys) & own[ts].between(ranges["from"], ranges["to"])
        near = own.join(ranges, inside, "left_semi")
        return saved(_merged(near, keys, ts, cols).select(*keys, ts, *[c.alias(name) for name, c in measures.items()]), "scan-readings")

    hours = formed(ranges)
    # Where a measure stands still through a whole frame, its std is zero and taken from farther on.
    joined = hours.alias("h").join(ranges.alias("r"), _same(hours, ranges, keys))
    stands = {"_before": F.col(f"h.{ts}") < F.col("r.lo"), "_after": F.col(f"h.{ts}") > F.col("r.hi") - span}
    still = [_any_still(measures, where).alias(name) for name, where in stands.items()]
    bounds = ("start", "end", "lo", "hi", "from", "to")
    flags = joined.groupBy(*[F.col(f"r.{c}").alias(c) for c in (*keys, *bounds)]).agg(*still)
    back, on = F.col("_before") & (F.col("from") > F.col("start")), F.col("_after") & (F.col("to") < F.col("end"))
    wider = flags.select(
        *keys, "start", "end",
        F.when(back, F.col("start")).otherwise(F.col("lo")).alias("lo"), F.when(on, F.col("end")).otherwise(F.col("hi")).alias("hi"),
        F.when(back, F.col("start")).otherwise(F.col("from")).alias("from"), F.when(on, F.col("end")).otherwise(F.col("to")).alias("to"),
        (back | on).alias("_wider"),
    )
    wider = saved(wider, "wider-ranges")
    if not wider.filter("_wider").isEmpty():
        ranges = wider.drop("_wider")
        hours = formed(ranges)
    cleaned = interpolate_linear(gapfill(hours, keys, ts).drop("is_observed"), keys, ts, list(measures))
    covered = saved(ranges.select(F.concat_ws("/", *keys).alias("series"), "lo", "hi"), "scanned-hours")
    found = detector(cleaned).alias("f")
    inside = F.col("f.series").eqNullSafe(F.col("c.series")) & F.col("f.ts").between(F.col("c.lo"), F.col("c.hi"))
    store.rescan(found.join(covered.alias("c"), inside, "left_semi"), covered, resource, now)


def _any_still(measures: Mapping[str, Column], where: Column) -> Column:
    """Whether some measure has one value at most in the hours where ``where`` holds."""
    out = F.lit(False)
    for m in measures:
        there = F.when(where, F.col(f"h.{m}"))
        out = out | F.coalesce(F.min(there) == F.max(there), F.lit(True))
    return out
