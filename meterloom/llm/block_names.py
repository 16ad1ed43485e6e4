"""Exact duplicates by deterministic block naming: blocks become integers, pairs of integers become
integers, until every text is one integer."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meterloom.llm.common import ship, stored, text_rows, unused

ship(__name__)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ITEM, TEXTS, DONE = 0, 1, 2
#: Items a naming task sorts, about.
BUCKET_ITEMS = 8192


def lowered(text: Column | str) -> Column:
    """A-Z to a-z, nothing else; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _rows(schema: pa.Schema, shard: int, items: list[bytes], done: list, open_: list, level: int) -> pa.Table:
    """Items by their number, texts that go on (ids, sha, path) and texts that are done (ids, sha, name)."""
    n = (len(items), len(open_), len(done))
    both = open_ + done
    columns = {
        "kind": np.repeat([ITEM, TEXTS, DONE], n).astype(np.int32),
        "shard": np.full(sum(n), shard, dtype=np.int64),
        "number": [*range(n[0]), *[None] * (n[1] + n[2])],
        "item": [*items, *[None] * (n[1] + n[2])],
        "ids": [*[None] * n[0], *[t[0] for t in both]],
        "sha": [*[None] * n[0], *[t[1] for t in both]],
        "path": [*[None] * n[0], *[t[2] for t in open_], *[None] * n[2]],
        "level": [*[None] * (n[0] + n[1]), *[level] * n[2]],
        "name": [*[None] * (n[0] + n[1]), *[t[2] for t in done]],
    }
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("kind", pa.int32()), ("shard", pa.int64()), ("number", pa.int32()), ("item", pa.binary()), ("ids", pa.list_(kind)),
        ("sha", pa.string()), ("path", pa.list_(pa.int64())), ("level", pa.int32()), ("name", pa.int64()),
    ])


def _cut(batches: Iterator[pa.RecordBatch], block_bytes: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Shards of whole texts: their distinct blocks with numbers, and each distinct text as numbers."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    number: dict[bytes, int] = {}
    texts: dict[tuple[int, ...], tuple[list, str]] = {}
    size, made = 0, 0
    schema = None
    for batch in batches:
        schema = _schema(batch.schema.field(0).type)
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if size > shard_bytes:
                yield from _rows(schema, base + made, list(number), [], [(i, s, p) for p, (i, s) in texts.items()], 0).to_batches()
                number, texts, size, made = {}, {}, 0, made + 1
            data = text.lower()  # of bytes: A-Z only
            path = tuple(number.setdefault(data[i : i + block_bytes], len(number)) for i in range(0, len(data), block_bytes))
            known = texts.get(path)
            if known is None:
                known = texts[path] = ([], hashlib.sha256(data).hexdigest())
                size += len(data) + 100
            known[0].append(doc_id)
            size += 16
    if texts:
        yield from _rows(schema, base + made, list(number), [], [(i, s, p) for p, (i, s) in texts.items()], 0).to_batches()


def _pair(level: int):
    """One shard: numbers of its items become names; texts of one name are done, others pair names up."""

    def run(key, texts: pa.Table, names: pa.Table) -> pa.Table:
        of = np.zeros(names.num_rows, dtype=np.int64)
        of[names["number"].to_numpy()] = names["name"].to_numpy()
        number: dict[tuple[int, int], int] = {}
        done, open_ = [], []
        paths = texts["path"].combine_chunks()
        flat, ends = of[paths.flatten().to_numpy(zero_copy_only=False)], np.append(0, np.cumsum(paths.value_lengths().to_numpy()))
        for k, (ids, sha) in enumerate(zip(texts["ids"].to_pylist(), texts["sha"].to_pylist(), strict=True)):
            own = flat[ends[k] : ends[k + 1]].tolist()
            if len(own) <= 1:
                done.append((ids, sha, own[0] if own else 0))
                continue
            own += [0] * (len(own) % 2)  # names begin at 1
            open_.append((ids, sha, [number.setdefault(p, len(number)) for p in zip(own[::2], own[1::2], strict=True)]))
        items = [struct.pack(">qq", *p) for p in number]
        return _rows(_schema(texts.schema.field("ids").type.value_type), key[0].as_py(), items, done, open_, level)

    return run


def _named(items: DataFrame, n: int) -> DataFrame:
    """(shard, number, name): equal items have one integer, different ones never the same.

    Items are dealt to buckets by a hash and sorted there; the name is made of the bucket and
    the item's place among its different items, so it depends on the set of items only, not on
    tasks or their order. A shard sends an item once, so the most frequent one comes once a shard.
    """
    buckets = n // BUCKET_ITEMS + 1
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)))
    place = F.expr("dense_rank() over (partition by bucket order by item)").cast("long") - 1
    return dealt.select("shard", "number", (place * buckets + F.col("bucket") + 1).alias("name"))


def exact_groups(
    docs: DataFrame, block_bytes: int = 1024, shard_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for every row of ``docs``.

    Texts are equal if they are after A-Z are lowered; null counts as empty. The row with the
    largest id stays (a null id is the smallest; of rows with one id and text exactly one has
    ``kept``). Empty texts are one group. An empty table gives no rows. Other columns play no part.

    A shard holds about ``shard_bytes`` of whole texts. It numbers its distinct blocks and says
    each distinct text as numbers; all shards' blocks are sorted into integer names and the names
    go back to the shards. From then on the items are pairs of adjacent names (an odd last one is
    paired with 0), until one name is left of each text: texts are equal if and only if level and
    name are. Every level is stored in the shared folder, so a lost executor costs no more than a
    part of one level. Blocks cross the network once a shard, pairs are 16 bytes, and copies within
    a shard travel as one text.
    """
    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, shard long, number int, item binary, ids array<{kind}>, sha string, path array<long>, level int, name long"
    parts = stored(rows.mapInArrow(lambda b: _cut(b, block_bytes, shard_bytes), schema), "blocks")
    done = []
    level = 0
    while True:
        done.append(parts.filter(f"kind = {DONE}").select("shard", "ids", "sha", "level", "name"))
        texts = parts.filter(f"kind = {TEXTS}").select("shard", "ids", "sha", "path")
        if texts.isEmpty():
            break
        items = parts.filter(f"kind = {ITEM}").select("shard", "number", "item")
        named = _named(items, items.count())
        parts = stored(texts.groupBy("shard").cogroup(named.groupBy("shard")).applyInArrow(_pair(level), schema), "names")
        level += 1
    texts = done[0]
    for more in done[1:]:
        texts = texts.unionByName(more)
    # A shard has a text once, so the largest group has a row a shard here, not a row a copy.
    places = F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.col("shard").alias("shard"), i.alias("at")))
    groups = texts.groupBy("level", "name").agg(
        F.sum(F.size("ids")).cast("long").alias("group_size"), F.max(F.array_max(places)).alias("last")
    )
    each = texts.join(groups, ["level", "name"]).select("*", F.posexplode("ids").alias("at", "doc_id"))
    return each.select(
        "doc_id",
        F.col("last.id").alias("keep_id"),
        "group_size",
        ((F.col("shard") == F.col("last.shard")) & (F.col("at") == F.col("last.at"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with one id and text any one."""
    kept = exact_groups(docs, id_col=id_col, text_col=text_col, **sizes).filter("kept")
    own = unused(docs, "__text_sha256")
    here = docs.withColumn(own, F.sha2(lowered(F.col(f"`{text_col}`")), 256))
    same = here[f"`{id_col}`"].eqNullSafe(kept["doc_id"]) & (here[own] == kept["text_sha256"])
    return here.join(kept, same, "left_semi").dropDuplicates([id_col, own]).drop(own)


#: The same in SQL.
ORACLE = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
WINDOW same AS (PARTITION BY body)"""
