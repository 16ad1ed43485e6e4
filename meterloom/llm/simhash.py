"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position has a non-zero vector over GF(2) of ``radius + 1`` bits; a table for
each non-zero v keeps the positions whose vector has an odd product with v. Any ``radius``
positions leave some v orthogonal to all their vectors, so two fingerprints that differ
there only are equal in that table: every pair within the radius collides somewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterloom.llm import near_texts
from meterloom.llm.common import checkpointed, compact, components, ship, text_rows, unused

ship(__name__)

BITS = 64


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 covering masks, as unsigned 64-bit numbers."""
    size = 2 ** (radius + 1) - 1
    vector = [1 + i % size for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str, width: int = 3, seed: int = 42) -> int:
    """Bit majority of the XXH64 of all word shingles, repeats included; no words: 0."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words) - width + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:n].tolist()
    h = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    step = 65_536  # shingles at a time: memory doesn't grow with the text
    for at in range(0, n, step):
        part = [h(line[a:b], seed) for a, b in zip(starts[at : at + step], ends[at + width - 1 : at + width - 1 + step].tolist(), strict=False)]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def simhashes(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as signed long) for every row. Null and empty texts: 0. Map only."""
    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [signed(simhash(t, width, seed)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint long")


def near_links(prints: DataFrame, radius: int = 2, small: int = 64) -> DataFrame:
    """Links (a, b) that join any two different fingerprints at most ``radius`` bits apart.

    ``prints`` has distinct ``fingerprint``. Each emits its masked value per table. In a
    bucket of at most ``small`` the pairs are compared directly. A larger one is never
    paired: its members emit themselves with up to ``radius // 2`` of the dropped bits
    turned over, and (odd radius: with one more on one side) link to the smallest member
    that shares a value. Two share a value iff they are within the radius, so these links
    connect the same fingerprints, and their number is linear in the bucket.
    """
    if radius != 2:
        raise ValueError("large buckets are linked through one-bit neighbours: the radius is 2")
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(masks(radius))])
    keyed = prints.select("fingerprint", F.explode(tables).alias("t")).select(
        "fingerprint", F.col("t.table").alias("table"), F.col("t.mask").alias("mask"),
        F.col("fingerprint").bitwiseAND(F.col("t.mask")).alias("key"),
    )
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    found = checkpointed(keyed.join(sizes, ["table", "key"]))
    few = found.filter(F.col("n") <= small)
    pairs = (
        few.alias("x").join(few.alias("y"), ["table", "key"]).filter("x.fingerprint < y.fingerprint")
        .filter(F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))) <= radius)
        .select(F.col("y.fingerprint").alias("a"), F.col("x.fingerprint").alias("b"))
    )
    flips = F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(BITS)])
    many = (
        found.filter(F.col("n") > small)
        .select("fingerprint", "table", "key", F.explode(F.filter(flips, lambda b: b.bitwiseAND(F.col("mask")) == 0)).alias("flip"))
        .select("fingerprint", "table", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("value"))
    )
    least = many.groupBy("table", "value").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("top")).filter("b < top")
    stars = many.join(least, ["table", "value"]).filter("fingerprint > b").select(F.col("fingerprint").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_groups(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as signed long, component_id) for every row.

    Fingerprints link within ``radius`` bits; component_id is the smallest doc_id that
    links reach, the row's own included. Equal fingerprints fold to one before any table is
    built, so groups of copies cost one row each. Texts without words have fingerprint 0
    and link like others. Rows without doc_id keep their group; a group of only such rows
    has no component_id.
    """
    found = checkpointed(simhashes(docs, id_col=id_col, text_col=text_col))
    prints = checkpointed(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    linked = components(near_links(prints.select("fingerprint"), radius))
    groups = prints.join(linked, prints["fingerprint"] == linked["node"], "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    firsts = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = groups.join(firsts, "component").select("fingerprint", "component_id")
    return found.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")


def sketches(docs: DataFrame, width: int, seed: int, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, size, bands, bits) for every row: its SimHash, and its signature of ``shingle``-word shingles. Map only."""
    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            marks = [near_texts.signature(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([signed(simhash(t, width, seed)) for t in texts], pa.int64()),
                 pa.array([m[0] for m in marks], pa.int32()), *(pa.array([m[i] for m in marks], pa.list_(pa.int64())) for i in (1, 2))],
                names=["doc_id", "fingerprint", "size", "bands", "bits"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint long, size int, bands array<long>, bits array<long>")


def one_of_each(
    docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42,
    alike: float | None = None, shingle: int = near_texts.WIDTH, small: int = 64,
) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id, of equal ids the smallest hash of the
    text, of equal rows any. Rows without doc_id come first. All columns stay.

    Texts are in one group if links join them: fingerprints (of ``width``-word shingles)
    within ``radius`` bits and, with ``alike``, texts that share that much of their distinct
    ``shingle``-word shingles, however far apart their fingerprints are.
    """
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("row"))
    name = unused(docs, "__key")
    keyed = docs.withColumn(name, key)
    if alike is None:
        found = checkpointed(simhashes(keyed, width, seed, id_col=name, text_col=text_col))
    else:
        found = checkpointed(sketches(keyed, width, seed, shingle, id_col=name, text_col=text_col))
    prints = checkpointed(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    links = near_links(prints.select("fingerprint"), radius)
    if alike is not None:
        links = compact(checkpointed(links))
        texts = found.groupBy(F.col("fingerprint").alias("node"), "doc_id.row").agg(*[F.first(c).alias(c) for c in ("size", "bands", "bits")])
        rows = text_rows(keyed, id_col=name, text_col=text_col).select("doc_id.row", "text")
        links = links.unionByName(near_texts.alike_links(texts, rows, links, alike, shingle, small))
    linked = components(links)
    kept = (
        prints.join(linked, prints["fingerprint"] == linked["node"], "left")
        .groupBy(F.coalesce("component", "fingerprint").alias("c")).agg(F.min("first").alias("kept")).select("kept")
    )
    # Kept rows that came more than once; only these move again.
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("kept"), F.lit(True).alias("more"))
    marked = checkpointed(kept.join(repeated, kept["kept"].eqNullSafe(repeated["kept"]), "left").select(kept["kept"], "more"))
    same = lambda k: keyed[name]["id"].eqNullSafe(k["kept"]["id"]) & (keyed[name]["row"] == k["kept"]["row"])
    single, more = marked.filter("more IS NULL"), marked.filter("more")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(single, same(single), "left_semi").select(*columns)
    if more.isEmpty():
        return once
    return once.unionByName(keyed.join(more, same(more), "left_semi").dropDuplicates([name]).select(*columns))


def as_hex(fingerprint: str = "fingerprint"):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fingerprint)), 16, "0"))
