"""Small files of a store, through Spark's own file systems (HDFS, object stores, local)."""

from __future__ import annotations

import uuid

from pyspark.errors.exceptions.captured import CapturedException
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, where = _place(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def text_of(spark: SparkSession, path: str) -> str:
    fs, where = _place(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that nobody has written yet; False if it is there.

    The text goes to a hidden file that is renamed without overwriting, the way Spark's
    streaming logs do it: readers see all of it or nothing, and of two writers one wins.
    """
    fs, where = _place(spark, path)
    if fs.exists(where):
        return False
    hidden = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(text.encode())
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    never = spark.sparkContext._gateway.new_array(options, 1)
    never[0] = options.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(hidden), fs.makeQualified(where), never)
    except (Py4JJavaError, CapturedException):
        fs.delete(hidden, False)
        if fs.exists(where):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.delete(where, True)
