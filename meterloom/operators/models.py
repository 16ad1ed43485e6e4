"""Learned forecasters on Spark ML, and a per-series seasonal regression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterloom.functions.numeric import floor_zero, minmax, minmax_inverse
from meterloom.functions.timeparts import calendar_columns
from meterloom.operators.features import lag_vector
from meterloom.operators.forecast import check_horizon, forecast_flat, half_std_bounds
from meterloom.operators.recent import tail_per_series
from meterloom.operators.windows import ordered
from meterloom.session import saved
from meterloom.sources.artifacts import load_model, path_exists, save_model

# ---------------------------------------------------------------- random forest

# Calendar inputs of the forest, its size, and its interval width.
FOREST_CALENDAR = ("month", "day_of_week", "is_weekend", "is_school_session", "quarter")
FOREST_TREES, FOREST_DEPTH, FOREST_SEED = 300, 10, 42
FOREST_MARGIN = 0.15


def forest_features(target: str, population: str) -> list[str]:
    return [
        *FOREST_CALENDAR, population, f"{target}_lag_1d", f"{target}_lag_7d",
        f"{target}_rolling_mean_7d",
    ]


def fit_forest(
    train: DataFrame, target: str, features: Sequence[str], trees: int = FOREST_TREES, depth: int = FOREST_DEPTH
) -> PipelineModel:
    """One forest over all series; missing inputs take the training medians.

    Feature windows leave one partition per group of series, so the rows are spread
    over all cores and kept for the passes of the fit (medians, splits, bagging).
    """
    filled = [f"{c}_in" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_inputs"),
        RandomForestRegressor(
            featuresCol="_inputs", labelCol=target, predictionCol="_raw", numTrees=trees,
            maxDepth=depth, seed=FOREST_SEED, featureSubsetStrategy="all", maxMemoryInMB=1024,
            cacheNodeIds=True,
        ),
    ]
    cast = train.select(*[F.col(c).cast("double").alias(c) for c in [*features, target]])
    spread = cast.repartition(train.sparkSession.sparkContext.defaultParallelism)
    spread.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(spread)
    finally:
        spread.unpersist()


def predict_forest(model: PipelineModel | None, df: DataFrame, features: Sequence[str], out: str = "predicted") -> DataFrame:
    """``df`` with the prediction, never below zero; NULL without a model."""
    if model is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    cast = df.withColumns({c: F.col(c).cast("double") for c in features})
    scored = model.transform(cast).withColumn(out, floor_zero("_raw"))
    return scored.drop("_inputs", "_raw", *[f"{c}_in" for c in features])


def forest_importances(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance), one row per input column."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    return spark.createDataFrame(rows, "feature string, importance double")


def forecast_forest(
    model: PipelineModel,
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    target: str,
    population: str,
    periods: int,
    seed_lags: bool = False,
) -> DataFrame:
    """Day-by-day forecast of every series, each prediction feeding the next lags.

    The state is one row per series with its last values in an array, so a step is
    a narrow projection: the loop runs over the horizon and never shuffles.
    ``seed_lags=True`` holds the 7-day lag at the first seed, and averages
    predictions only, until a week of predictions exists. A series with less than a week
    of history gets the flat forecast, and its ``method`` says so.
    """
    periods = check_horizon(periods)
    features = forest_features(target, population)
    week = F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), F.col(target).cast("double").alias("v"))))
    state = (
        tail_per_series(df, keys, date, 7)
        .groupBy(*keys)
        .agg(
            F.transform(week, lambda e: e["v"]).alias("_hist"),
            F.avg(population).alias(population),
            F.max(date).alias("_last"),
        )
        .filter(F.size("_hist") == 7)
    )
    for step in range(periods):
        inputs = _forest_inputs(target, step, seed_lags)
        names = {n: c for n, c in calendar_columns("_day", hourly=False).items() if n in FOREST_CALENDAR}
        rows = state.withColumn("_day", F.date_add("_last", step + 1)).withColumns(names | inputs)
        scored = predict_forest(model, rows, features, "_yhat")
        state = scored.select(
            *keys, "_last", population, F.concat("_hist", F.array("_yhat")).alias("_hist")
        )
    days = state.select(*keys, "_last", F.posexplode(F.slice("_hist", 8, periods)).alias("_i", "forecast"))
    learned = days.select(
        *keys,
        F.date_add("_last", F.col("_i") + 1).alias(date),
        "forecast",
        (F.col("forecast") * (1 - FOREST_MARGIN)).alias("lower"),
        (F.col("forecast") * (1 + FOREST_MARGIN)).alias("upper"),
        F.lit("random_forest").alias("method"),
    )
    return _with_flat(learned, df, keys, date, target, periods, 7, FOREST_MARGIN)


def _with_flat(
    learned: DataFrame, df: DataFrame, keys: Sequence[str], date: str, col: str, periods: int, least: int, margin: float,
    unknown: DataFrame | None = None,
) -> DataFrame:
    """``learned`` and the flat forecast of the series it leaves out: fewer than ``least`` rows, or in ``unknown``."""
    short = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < least).select(*keys)
    if unknown is not None:
        short = short.union(unknown.select(*keys)).distinct()
    flat = forecast_flat(df.join(short, list(keys), "left_semi"), keys, date, col, periods, margin)
    return learned.unionByName(flat)


def _forest_inputs(target: str, step: int, seed_lags: bool) -> dict[str, Column]:
    week_ago, recent = F.element_at("_hist", -7), F.slice("_hist", -7, 7)
    if seed_lags and step < 7:
        week_ago = F.element_at("_hist", 1)
        recent = F.slice("_hist", -7, 7) if step == 0 else F.slice("_hist", -step, step)
    mean = F.aggregate(recent, F.lit(0.0), lambda a, v: a + v) / F.size(recent)
    return {
        f"{target}_lag_1d": F.element_at("_hist", -1),
        f"{target}_lag_7d": week_ago,
        f"{target}_rolling_mean_7d": mean,
    }


# ---------------------------------------------------------------- autoregression

AR_STEPS = 14  # fixed value: days of history the autoregression looks at
BLOCK_BITS = 7  # a backcast is made in blocks of 2 ** BLOCK_BITS days
AR_FLAT_MARGIN = 0.10  # of the flat forecast that short series get


@dataclass(frozen=True)
class Autoregression:
    """Pooled linear model on min–max scaled lags, and each series' scale."""

    coefficients: tuple[float, ...]
    intercept: float
    scale: DataFrame  # keys, lo, hi

    @property
    def steps(self) -> int:
        return len(self.coefficients)

    def step_weights(self, spark: SparkSession, steps: int) -> DataFrame:
        """(step, weights, constant): what the value ``step`` days ahead takes from the seed days.

        The model is linear, so a free run of any length is a fixed combination of its
        seeds; the table has a row a day and does not grow with the series.
        """
        n = self.steps
        reach = [([float(i == j) for j in range(n)], 0.0) for i in range(n)]
        for _ in range(steps):
            near = reach[-n:]
            weights = [sum(c * w[j] for c, (w, _) in zip(self.coefficients, near)) for j in range(n)]
            reach.append((weights, self.intercept + sum(c * k for c, (_, k) in zip(self.coefficients, near))))
        rows = [(i + 1, w, k) for i, (w, k) in enumerate(reach[n:])]
        return spark.createDataFrame(rows, "_step int, _weights array<double>, _constant double")


def _ahead(seeds: Column) -> Column:
    """Value of a step from the seed days."""
    return _dot("_weights", seeds) + F.col("_constant")


def _scaled(df: DataFrame, scale: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """A series that the training did not see is scaled by its own range."""
    own = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).join(scale, list(keys), "left")
    known = own.select(*keys, F.coalesce("lo", "_lo").alias("lo"), F.coalesce("hi", "_hi").alias("hi"))
    return df.join(known, list(keys)).withColumn("_scaled", minmax(col, "lo", "hi"))


def fit_autoregression(
    train: DataFrame, keys: Sequence[str], date: str, col: str, steps: int = AR_STEPS
) -> tuple[Autoregression, LinearRegressionModel]:
    """Fit on every series at once; the scale comes from each series' training range."""
    scale = train.groupBy(*keys).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    rows = lag_vector(_scaled(train, scale, keys, col), keys, date, "_scaled", steps)
    fitted = LinearRegression(
        featuresCol="_inputs", labelCol="_scaled", solver="normal", regParam=1e-6, elasticNetParam=0.0
    ).fit(rows.select("_scaled", array_to_vector("lags").alias("_inputs")))
    return from_linear(fitted, scale), fitted


def from_linear(model: LinearRegressionModel, scale: DataFrame) -> Autoregression:
    return Autoregression(tuple(float(c) for c in model.coefficients), float(model.intercept), scale)


def save_autoregression(fitted: LinearRegressionModel, model: Autoregression, path: str) -> str:
    save_model(fitted, f"{path}/weights")
    model.scale.write.mode("overwrite").parquet(f"{path}/scale")
    return path


def load_autoregression(spark: SparkSession, path: str) -> Autoregression | None:
    fitted = load_model(spark, f"{path}/weights", LinearRegressionModel)
    return from_linear(fitted, spark.read.parquet(f"{path}/scale")) if fitted else None


def _sorted_values(date: str, col: str) -> Column:
    pairs = F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), F.col(col).alias("v"))))
    return F.transform(pairs, lambda e: e["v"])


def forecast_autoregression(
    model: Autoregression, df: DataFrame, keys: Sequence[str], date: str, col: str, periods: int
) -> DataFrame:
    """Recursive forecast as one dot product a day. A series with fewer rows than the model
    looks back gets the flat forecast, and its ``method`` says so."""
    horizon = check_horizon(periods)
    recent = tail_per_series(_scaled(df, model.scale, keys, col), keys, date, model.steps)
    seeds = (
        recent.groupBy(*keys)
        .agg(
            _sorted_values(date, "_scaled").alias("_seed"),
            F.max(date).alias("_last"),
            F.first("lo").alias("lo"),
            F.first("hi").alias("hi"),
        )
        .filter(F.size("_seed") == model.steps)
    )
    spread = df.groupBy(*keys).agg(F.stddev_samp(col).alias("_std"))
    steps = seeds.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    days = steps.join(model.step_weights(df.sparkSession, horizon), "_step").withColumn("_value", _ahead(F.col("_seed")))
    learned = (
        days.withColumn("forecast", floor_zero(minmax_inverse("_value", "lo", "hi")))
        .withColumn(date, F.date_add("_last", F.col("_step")))
        .join(spread, list(keys))
        .select(*keys, date, "forecast", *half_std_bounds("forecast", "_std"), F.lit("autoregression").alias("method"))
    )
    return _with_flat(learned, df, keys, date, col, horizon, model.steps, AR_FLAT_MARGIN)


def _matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in row) + ")" for row in rows) + ")")


def _states(model: Autoregression, seeds: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """keys, _block, _seed: the days that the free run has just made when a block begins.

    A block of days moves the state by a fixed matrix; its squares move it by 2, 4, 8 ... blocks. So
    every block of a series is reached in as many steps as its number has bits, and a step doubles
    the rows there are up to the series' own ``_last_block``. ``most`` is the largest of these.
    """
    n = model.steps
    # The last value is a constant one, so that a step is a product.
    step = [[float(j == i + 1) for j in range(n + 1)] for i in range(n - 1)] + [[*model.coefficients, model.intercept], [0.0] * n + [1.0]]

    def times(a, b):
        return [[sum(x * y for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)] for row in a]

    power = step
    for _ in range(BLOCK_BITS):
        power = times(power, power)
    out = seeds.select(*keys, "_last_block", F.lit(0).alias("_block"), F.concat("_seed", F.array(F.lit(1.0))).alias("_state"))
    for bit in range(most.bit_length()):
        ahead = F.transform(_matrix(power), lambda row: F.aggregate(F.zip_with(row, "_state", lambda w, x: w * x), F.lit(0.0), lambda a, v: a + v))
        later = F.struct((F.col("_block") + (1 << bit)).alias("_block"), ahead.alias("_state"))
        both = F.array(F.struct("_block", "_state"), F.when(F.col("_block") + (1 << bit) <= F.col("_last_block"), later))
        out = out.select(*keys, "_last_block", F.explode(F.array_compact(both)).alias("_s")).select(*keys, "_last_block", "_s.*")
        power = times(power, power)
    return out.select(*keys, "_block", F.slice("_state", 1, n).alias("_seed"))


def backcast_autoregression(
    model: Autoregression, df: DataFrame, keys: Sequence[str], date: str, col: str
) -> DataFrame:
    """In-sample path: the first rows echo the actuals, the rest runs free from them.

    The free run is cut into blocks. A row is a dot product of the state its block begins with and
    the weights of its place in the block, so the cost is the same for every day, nothing is
    collected, and what the driver makes does not grow with the series.
    """
    block = 1 << BLOCK_BITS
    rows = _scaled(df, model.scale, keys, col).select(
        *keys, date, F.col(col).alias("actual"), "_scaled", "lo", "hi", (F.row_number().over(ordered(keys, date)) - 1).alias("idx")
    )
    first = F.sort_array(F.collect_list(F.when(F.col("idx") < model.steps, F.struct("idx", F.col("_scaled").alias("v")))))
    ahead = F.greatest(F.col("idx") - model.steps, F.lit(0))
    rows = rows.withColumns({"_block": F.floor(ahead / block).cast("int"), "_step": ahead % block + 1})
    seeds = rows.groupBy(*keys).agg(F.transform(first, lambda e: e["v"]).alias("_seed"), F.max("_block").alias("_last_block"))
    seeds = saved(seeds, "seeds")
    most = seeds.agg(F.max("_last_block")).first()[0] or 0
    full = seeds.filter(F.size("_seed") == model.steps)
    states = _states(model, full, keys, most)
    weights = model.step_weights(df.sparkSession, block)
    joined = rows.join(states, [*keys, "_block"], "left").join(weights, "_step", "left")
    free = floor_zero(minmax_inverse(_ahead(F.col("_seed")), "lo", "hi"))
    return joined.select(
        *keys, date, "idx", "actual", F.when(F.col("idx") < model.steps, F.col("actual")).otherwise(free).alias("predicted")
    )


# ---------------------------------------------------------------- seasonal regression

# Fourier orders, ridge strength and the z of an 80 % interval.
WEEKLY_ORDER, YEARLY_ORDER = 3, 10
RIDGE = 1e-3
INTERVAL_Z = 1.2816


def _terms(day: Column, regressors: Sequence[str]) -> Column:
    """Inputs of a day: constant, trend, weekly and yearly waves, scaled regressors (0 if missing)."""
    parts = [F.lit(1.0), (day - F.col("start")) / F.col("span")]
    for period, order in ((7.0, WEEKLY_ORDER), (365.25, YEARLY_ORDER)):
        for k in range(1, order + 1):
            angle = day * F.lit(2 * math.pi * k / period)
            parts += [F.sin(angle), F.cos(angle)]
    for i, name in enumerate(regressors):
        scaled = (F.col(name).cast("double") - F.get("centre", F.lit(i))) / F.get("scale", F.lit(i))
        parts.append(F.coalesce(scaled, F.lit(0.0)))
    return F.array(*parts)


def _solved(sums: Column, n: int, rows: Column) -> Column:
    """Weights of the ridge regression whose ``sums`` are the products of all pairs of inputs and target.

    ``sums`` is the upper triangle of an (n + 1)-square matrix, row by row. The system is
    symmetric and, with the ridge, positive definite, so elimination needs no pivoting.
    """
    m = n + 1

    def at(i: Column, j: Column) -> Column:
        a, b = F.least(i, j), F.greatest(i, j)
        return F.get(sums, (a * m - F.floor(a * (a - 1) / 2) + b - a).cast("int"))

    numbers = lambda k: F.array(*[F.lit(x) for x in range(k)])
    ridge = lambda i, j: F.when((i == j) & (i > 0), rows * RIDGE).otherwise(0.0)
    system = F.transform(numbers(n), lambda i: F.transform(numbers(m), lambda j: at(i, j) + ridge(i, j)))

    def eliminate(matrix: Column, k: Column) -> Column:
        pivot = F.get(matrix, k)
        return F.transform(
            matrix,
            lambda row, i: F.when(i == k, F.transform(row, lambda x: x / F.get(row, k))).otherwise(
                F.zip_with(row, pivot, lambda x, p: x - F.get(row, k) / F.get(pivot, k) * p)
            ),
        )

    return F.transform(F.aggregate(numbers(n), system, eliminate), lambda row: F.get(row, F.lit(n)))


def _dot(weights: str, terms: Column) -> Column:
    return F.aggregate(F.zip_with(weights, terms, lambda w, x: w * x), F.lit(0.0), lambda a, v: a + v)


def fit_seasonal(history: DataFrame, keys: Sequence[str], date: str, col: str, regressors: Sequence[str]) -> DataFrame:
    """Trend + weekly + yearly terms + regressors by least squares, a row of weights per series.

    Days without a value are left out. The products of inputs fold to one sum per pair in
    the map tasks; each series then solves one small system. Only built-in functions.
    """
    day = F.unix_date(date).cast("double")
    known = history.filter(F.col(col).isNotNull()).select(
        *keys, day.alias("_day"), F.col(col).cast("double").alias("_y"), *[F.col(r).cast("double").alias(r) for r in regressors]
    )
    spread = lambda r: F.coalesce(F.nullif(F.stddev_samp(r), F.lit(0.0)), F.lit(1.0))
    kind = "array<double>"
    scale = known.groupBy(*keys).agg(
        F.min("_day").alias("start"),
        F.greatest(F.max("_day") - F.min("_day"), F.lit(1.0)).alias("span"),
        F.array(*[F.avg(r) for r in regressors]).cast(kind).alias("centre"),
        F.array(*[spread(r) for r in regressors]).cast(kind).alias("scale"),
        F.count(F.lit(1)).alias("_rows"),
    )
    n = 2 + 2 * (WEEKLY_ORDER + YEARLY_ORDER) + len(regressors)
    inputs = known.join(scale, list(keys)).select(*keys, "_y", _terms(F.col("_day"), regressors).alias("_x"))
    z = F.concat("_x", F.array("_y"))
    pairs = F.flatten(F.transform(z, lambda a, i: F.transform(F.slice(z, i + 1, n + 1), lambda b: a * b)))
    sums = inputs.select(*keys, F.posexplode(pairs).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    rows = sums.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("_sums")
    )
    solved = rows.join(scale, list(keys)).withColumn("weights", _solved(F.col("_sums"), n, F.col("_rows")))
    fitted = solved.select(*keys, "start", "span", "centre", "scale", "weights")
    left = known.join(fitted, list(keys)).withColumn("_r", F.col("_y") - _dot("weights", _terms(F.col("_day"), regressors)))
    width = left.groupBy(*keys).agg((F.stddev_pop("_r") * INTERVAL_Z).alias("width"))
    return fitted.join(width, list(keys))


def predict_seasonal(model: DataFrame, wanted: DataFrame, keys: Sequence[str], date: str, regressors: Sequence[str]) -> DataFrame:
    """A forecast for every wanted day; NULL for a series that the model doesn't know."""
    rows = wanted.select(*keys, date, *regressors).join(model, list(keys), "left")
    mean = _dot("weights", _terms(F.unix_date(date).cast("double"), regressors))
    floor = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    return rows.withColumn("_mean", mean).select(
        *keys,
        date,
        floor(F.col("_mean")).alias("forecast"),
        floor(F.col("_mean") - F.col("width")).alias("lower"),
        (floor(F.col("_mean")) + F.col("width")).alias("upper"),
        F.when(F.col("_mean").isNotNull(), "seasonal_regression").alias("method"),
    )


def seasonal_regression(
    history: DataFrame, wanted: DataFrame, keys: Sequence[str], date: str, col: str, regressors: Sequence[str]
) -> DataFrame:
    """Fit on the history, forecast the wanted days."""
    return predict_seasonal(fit_seasonal(history, keys, date, col, regressors), wanted, keys, date, regressors)


def save_seasonal(model: DataFrame, path: str) -> str:
    model.write.mode("overwrite").parquet(path)
    return path


def load_seasonal(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, path) else None
