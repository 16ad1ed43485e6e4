"""Fault-tolerant ingest: a failing source is reported, the others go on."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from meterloom.session import saved
from meterloom.sources.csv_tables import CORRUPT

Reader = Callable[[], DataFrame]

REPORT = "source string, status string, row_count long, corrupt_count long, error string"


@dataclass
class Ingested:
    """Frames that could be read and the errors of those that could not.

    ``corrupt`` counts the rows that did not fit their schema; they are in the frames,
    with NULL where a value could not be read.
    """

    frames: dict[str, DataFrame] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    corrupt: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.errors

    def report(self, spark: SparkSession) -> DataFrame:
        """One row per source: loaded or failed, rows, rows that did not fit, error text."""
        loaded = [(s, "loaded", self.rows.get(s), self.corrupt.get(s), None) for s in self.frames]
        failed = [(s, "failed", None, None, e) for s, e in self.errors.items()]
        return spark.createDataFrame(loaded + failed, REPORT)


def ingest(readers: Mapping[str, Reader], count_rows: bool = True) -> Ingested:
    """Run every reader; reading is lazy, so only an action can tell whether it works.

    A source that is parsed (it has the corrupt-record column) is read once: that pass writes
    the table that its frame reads from then on, and observes the number of rows and of those
    that did not fit on the way; a line that can't be read fails here, not in a later plan. The
    corrupt-record column is dropped. Other sources are tables already: their rows are counted,
    which needs no column. With ``count_rows=False`` the first row is looked at and nothing is stored.
    """
    out = Ingested()
    for source, reader in readers.items():
        try:
            df = reader()
            marked = CORRUPT in df.columns
            if not count_rows:
                df.isEmpty()
                df = df.drop(CORRUPT) if marked else df
            elif marked:
                seen = Observation()
                bad = F.count_if(F.col(CORRUPT).isNotNull())
                df = saved(df.observe(seen, F.count(F.lit(1)).alias("rows"), bad.alias("corrupt")).drop(CORRUPT), "ingested")
                out.rows[source], out.corrupt[source] = seen.get["rows"], seen.get["corrupt"]
            else:
                out.rows[source] = df.count()
            out.frames[source] = df
        except (PySparkException, OSError, ValueError) as error:
            out.errors[source] = str(error).splitlines()[0]
    return out
