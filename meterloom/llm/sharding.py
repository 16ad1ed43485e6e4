"""Sharding by extendible hashing: a directory of hash-prefix bits, split only where it is too full."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from meterloom.llm.common import checkpointed, unused

WORD = 60  # bits of a hash word
#: Directory bits that one pass may look below the depth an even spread would need.
SPARE = 6
MOST_BITS = 24
#: Depths that are looked at on the driver, as sums of at most 2 ** COARSE prefixes.
COARSE = 12


def first_bits(value: Column, bits: int) -> Column:
    """The upper ``bits`` of a WORD-bit number."""
    return F.shiftright(value, WORD - bits)


def id_word(id_col: str) -> Column:
    """The first 60 bits of md5 of the id as text; a missing id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def bit_text(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))


def shallowest(cells: DataFrame, bits: int, limit: int) -> int:
    """A depth above which no bucket of the first bits fits: the shallowest that does, or as far as
    ``COARSE`` bits say. Prefixes shorter than that need no sums of their own, which would bring
    the cells of half the table to one key."""
    coarse = min(COARSE, bits)
    sums = cells.groupBy(F.expr(f"shiftright(__cell, {bits - coarse})").alias("p")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    nodes = {r["p"]: (r["bytes"], r["n"]) for r in sums.collect()}  # at most 2 ** COARSE
    found = coarse
    for depth in range(coarse, -1, -1):
        if any(b <= limit or n == 1 for b, n in nodes.values()):
            found = depth
        upper: dict[int, tuple[int, int]] = {}
        for p, (b, n) in nodes.items():
            old = upper.get(p >> 1, (0, 0))
            upper[p >> 1] = (old[0] + b, old[1] + n)
        nodes = upper
    return found


def extendible_shards(
    docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_rows) for every row, and with ``keep`` those
    columns in a struct ``kept``.

    ``shard`` is the bucket's hash prefix as bits, ``depth`` their number. A bucket of at
    most ``limit`` bytes stays whole; a larger one splits on its next bit. A row alone in
    its bucket is a shard even if it is larger than the limit. Rows that share an id split
    on a hash of the text, repeated rows on their row number. Null texts have 0 bytes.

    A pass folds the rows to byte sums per cell of many bits, adds these up for every
    shorter prefix, and gives each cell the shortest prefix that fits. Cells that don't fit
    with all bits go to a next pass with further bits; other rows do not.
    """
    if limit < 1:
        raise ValueError("a shard needs a limit of a byte or more")
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    carried = ["kept"] if keep else []
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"),
        *kept,
        F.array(
            id_word(f"`{id_col}`"),
            F.shiftrightunsigned(F.xxhash64(f"`{text_col}`"), 64 - WORD),
            F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - WORD),
        ).alias("__words"),
        F.lit("").alias("__path"),
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    step = min(MOST_BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE)
    done, word, used = [], 0, 0
    while True:
        bits = min(step, WORD - used)
        # The next bits of the current word, below those that the path already has.
        lower = F.col("__words")[word].bitwiseAND(F.lit((1 << (WORD - used)) - 1))
        celled = rows.withColumn("__cell", F.shiftright(lower, WORD - used - bits))
        cells = checkpointed(celled.groupBy("__path", "__cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")))
        top = 0 if used or word else shallowest(cells, bits, limit)
        levels = cells.select("*", F.explode(F.sequence(F.lit(top), F.lit(bits))).alias("d")).withColumn(
            "prefix", F.expr(f"shiftright(__cell, {bits} - d)")
        )
        nodes = levels.groupBy("__path", "d", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        fits = nodes.filter((F.col("bytes") <= limit) | (F.col("n") == 1)).withColumnsRenamed({"bytes": "shard_bytes", "n": "shard_rows"})
        leaves = (
            levels.select("__path", "__cell", "d", "prefix").join(fits, ["__path", "d", "prefix"])
            .groupBy("__path", "__cell").agg(F.min(F.struct("d", "prefix", "shard_bytes", "shard_rows")).alias("leaf"))
        )
        placed = celled.join(leaves, ["__path", "__cell"], "left")
        shard = F.concat("__path", bit_text(F.col("leaf.prefix"), F.col("leaf.d")))
        done.append(
            placed.filter("leaf IS NOT NULL").select(
                "doc_id", "n_bytes", *carried, shard.alias("shard"),
                F.length(shard).cast("long").alias("depth"), "leaf.shard_bytes", "leaf.shard_rows",
            )
        )
        left = cells.join(leaves, ["__path", "__cell"], "left_anti")
        word, used = (word + 1, 0) if used + bits == WORD else (word, used + bits)
        if left.isEmpty():
            break
        if word == 3:
            raise RuntimeError("rows that differ in no bit of their hashes exceed the limit")
        rows = placed.filter("leaf IS NULL").select(
            "doc_id", "n_bytes", *carried, "__words",
            F.concat("__path", bit_text(F.col("__cell"), F.lit(bits))).alias("__path"),
        )
        step = min(MOST_BITS, SPARE + 6)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Documents written as Parquet under ``path``, a folder for each shard."""
    folder = unused(docs, "shard")
    placed = extendible_shards(docs, limit, id_col, text_col, keep=tuple(docs.columns))
    placed.select("kept.*", F.col("shard").alias(folder)).repartition(folder).write.partitionBy(folder).parquet(path)


#: The same buckets by prefix sums over every depth; ids are taken to be different.
ORACLE = """
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
l AS (
  SELECT doc_id, n_bytes, d, h >> (60 - d)::INT AS prefix,
         sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows
  FROM r CROSS JOIN range(0, 41) AS t(d)
  WINDOW w AS (PARTITION BY d, h >> (60 - d)::INT)),
f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k
  FROM l WHERE shard_bytes <= {limit} OR shard_rows = 1)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(prefix), d::INT, '0') END AS shard, d AS depth,
       shard_bytes::BIGINT AS shard_bytes, shard_rows
FROM f WHERE k = 1
"""
