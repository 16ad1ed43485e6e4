"""Model and metrics files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterloom import schemas


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, as Spark's readers see it."""
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018  (resolves the path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str, kind=PipelineModel):
    """The saved model, or None where there is none."""
    return kind.load(path) if path_exists(spark, path) else None


def save_metrics(metrics: DataFrame, path: str) -> str:
    """Metrics rows as JSON; a column that is not there is NULL."""
    there = set(metrics.columns)
    cols = [
        (F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.METRICS.fields
    ]
    metrics.select(*cols).write.mode("overwrite").json(path)
    return path


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Saved metrics rows; none if nothing was saved."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.METRICS)
    return spark.read.schema(schemas.METRICS).json(path)
