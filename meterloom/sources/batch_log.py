"""A table made of published batches that are merged level by level."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, types as T

from meterloom.sources.files import names_in, put_new, remove, text_of

#: Batches of a level that become one of the next.
FANOUT = 8


@dataclass(frozen=True)
class Manifest:
    """The live batches as (name, level). ``mark`` is the last numbered batch; ``merged`` are the
    batches that the last merge replaced, whose files readers of the version before may still read."""

    version: int = 0
    batches: tuple[tuple[str, int], ...] = ()
    mark: int = -1
    merged: tuple[str, ...] = ()
    schema: str | None = None


@dataclass(frozen=True)
class BatchLog:
    """Parquet folders ``data/batch=<name>`` and a manifest that says which of them count.

    A batch is written aside and published by the next manifest version, a file that can be
    made once only; a writer that comes second reads the new version and tries the one after.
    Readers take the latest version, so they see a batch whole or not at all, and what broken
    attempts left is never read. ``FANOUT`` batches of a level are folded into one of the next:
    n batches leave at most ``FANOUT`` times log n live ones. Replaced files go a merge later.
    """

    spark: SparkSession
    root: str
    partition_by: tuple[str, ...] = ()

    def _folder(self, name: str) -> str:
        return f"{self.root}/data/batch={name}"

    def manifest(self) -> Manifest:
        """The latest version."""
        while True:
            versions = [int(n) for n in names_in(self.spark, f"{self.root}/manifest") if n.isdigit()]
            if not versions:
                return Manifest()
            try:
                found = json.loads(text_of(self.spark, f"{self.root}/manifest/{max(versions):010d}"))
            except Exception:
                if max(versions) == max((int(n) for n in names_in(self.spark, f"{self.root}/manifest") if n.isdigit()), default=0):
                    raise
                continue  # replaced by a later one meanwhile
            return Manifest(
                max(versions), tuple((n, k) for n, k in found["batches"]), found["mark"], tuple(found["merged"]), found["schema"]
            )

    def publish(self, change: Callable[[Manifest], Manifest | None]) -> bool:
        """Make ``change`` of the latest manifest the next one; False if it has nothing to change."""
        while True:
            now = self.manifest()
            then = change(now)
            if then is None:
                return False
            text = json.dumps({"batches": then.batches, "mark": then.mark, "merged": then.merged, "schema": then.schema})
            if put_new(self.spark, f"{self.root}/manifest/{now.version + 1:010d}", text):
                for old in range(max(1, now.version - 1), now.version):
                    remove(self.spark, f"{self.root}/manifest/{old:010d}")
                return True

    def _write(self, rows: DataFrame, name: str) -> None:
        if self.partition_by:
            rows = rows.hint("rebalance", *self.partition_by)
        rows.write.mode("overwrite").partitionBy(*self.partition_by).parquet(self._folder(name))

    def append(self, rows: DataFrame, number: int | None = None) -> bool:
        """Publish ``rows`` as a batch. A numbered batch that is published already stays as it is."""
        if number is not None and number <= self.manifest().mark:
            return False
        name = uuid.uuid4().hex if number is None else f"{number:010d}"
        self._write(rows, name)

        def add(now: Manifest) -> Manifest | None:
            if number is not None and number <= now.mark:
                return None
            mark = now.mark if number is None else number
            return replace(now, batches=(*now.batches, (name, 0)), mark=mark, schema=now.schema or rows.schema.json())

        return self.publish(add)

    def read(self, only: Sequence[str] | None = None, manifest: Manifest | None = None) -> DataFrame | None:
        """The rows of all live batches, or of some; None if nothing was ever published."""
        now = manifest or self.manifest()
        if now.schema is None:
            return None
        names = [n for n, _ in now.batches] if only is None else list(only)
        schema = T.StructType.fromJson(json.loads(now.schema))
        if not names:
            return self.spark.createDataFrame([], schema)
        typed = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
        reader = self.spark.read.schema(typed).option("basePath", f"{self.root}/data")
        return reader.parquet(*[self._folder(n) for n in names]).select(*schema.names)

    def merge(self, fold: Callable[[DataFrame], DataFrame], fanout: int = FANOUT) -> int:
        """Fold full levels, lowest first; how many merges there were.

        The merged batch is named after its inputs: a merge that broke off is written over. It
        counts only if all its inputs are still live when it is published.
        """
        done = 0
        while True:
            now = self.manifest()
            levels: dict[int, list[str]] = {}
            for name, level in now.batches:
                levels.setdefault(level, []).append(name)
            full = min((k for k, names in levels.items() if len(names) >= fanout), default=None)
            if full is None:
                return done
            names = levels[full]
            into = f"{full + 1}-{names[0].split('-')[-1]}-{names[-1].split('-')[-1]}"
            self._write(fold(self.read(names, now)), into)

            def swap(latest: Manifest, names=names, into=into, level=full + 1) -> Manifest | None:
                live = [n for n, _ in latest.batches]
                if not set(names) <= set(live):
                    return None
                at = live.index(names[0])
                rest = [b for b in latest.batches if b[0] not in names]
                rest.insert(min(at, len(rest)), (into, level))
                return replace(latest, batches=tuple(rest), merged=tuple(names))

            if self.publish(swap):
                for old in now.merged:
                    remove(self.spark, self._folder(old))
                done += 1

    def drop(self, names: Sequence[str]) -> None:
        """Batches that are no longer needed leave the table."""
        gone = set(names)
        before = self.manifest().merged

        def without(now: Manifest) -> Manifest | None:
            if not gone & {n for n, _ in now.batches}:
                return None
            return replace(now, batches=tuple(b for b in now.batches if b[0] not in gone), merged=tuple(sorted(gone)))

        if self.publish(without):
            for old in before:
                remove(self.spark, self._folder(old))
