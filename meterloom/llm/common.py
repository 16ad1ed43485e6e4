"""Helpers the text operators share: tables, batches, checkpoints, vocabulary files."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def ship(module: str) -> None:
    """Send the functions of ``module`` to Python workers by value.

    Executors then need the public libraries only, not this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_rows(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and the columns in ``more``; other columns are left out,
    so no name in ``docs`` can clash with a helper column."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in more],
    )


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; a cluster without it
    is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="meterloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def partitions_for(df: DataFrame, rows: int) -> int:
    """A partition for every ``rows`` rows of ``df``, a checkpoint, and one at least."""
    return max(1, -(-df.count() // rows))


def compact(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df``, a checkpoint, in a partition for every ``rows`` rows, if it has more of them.

    What reads a small table then takes a few tasks and shuffle files, not one for each of
    the partitions that a large input has; a large table stays as it is.
    """
    return df.coalesce(partitions_for(df, rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new place in the shared folder, and read from there."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vocabulary(path: str) -> bytes:
    """A vocabulary file, read once on the driver and sent along with the task's function.
    The public files are under 2 MB, whatever the size of the input."""
    with open(path, "rb") as file:
        return file.read()


#: A-Z to a-z; other ASCII that is no letter or digit to a space. Bytes of other characters belong to words.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words of a text in UTF-8: runs of a-z, 0-9 and all that isn't ASCII, after A-Z are lowered."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def by_bytes(items: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Consecutive items in lists of about ``limit`` bytes (UTF-8 length is at most 4 × code points,
    code points are counted here); one longer item makes a list of its own."""
    part: list[str] = []
    size = 0
    for item in items:
        if part and size + len(item) > limit:
            yield part
            part, size = [], 0
        part.append(item)
        size += len(item)
    if part:
        yield part


def joined_spans(spans: Column) -> Column:
    """Array of structs (kind, start, end) as ``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node in ``links`` (a, b).

    Each round, a node tells all its neighbours and itself to link to the smallest of them
    (first for larger neighbours, then for smaller ones), which shortens paths by a factor
    every round and never adds links. A node with many neighbours is handled by an
    aggregate and a join on nodes, not by a list. Rounds go on until nothing changes;
    each is checkpointed, so a lost executor costs one round. Rounds run in a partition for
    every 20,000 links, as a few links in many partitions are many stages of empty tasks and files.
    """
    edges = checkpointed(links.select("a", "b").filter("a <> b").distinct())
    parts = partitions_for(edges, 20_000)
    edges = edges.coalesce(parts)
    for _ in range(rounds):
        larger = _star(edges, True, parts)
        smaller = checkpointed(_star(larger, False, parts)).coalesce(parts)
        same = smaller.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        # A star: every larger node has one link, and no centre has a link of its own.
        centres = smaller.select(F.col("b").alias("a")).distinct()
        if same and smaller.join(centres, "a", "left_semi").isEmpty():
            return smaller.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                centres.select(F.col("a").alias("node"), F.col("a").alias("component"))
            ).coalesce(parts)
        edges = smaller
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One round of stars, in ``parts`` partitions at its unions. Large: from every node to its
    larger neighbours. Small: to its smaller ones and itself. Result has a > b."""
    both = edges.select("a", "b").union(edges.select("b", "a")).coalesce(parts) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    told = both.join(least, "a")
    if large:
        out = told.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = told.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        ).coalesce(parts)
    return out.filter("a <> b").distinct()


def count_of(kind: str, spans: str = "spans") -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
