"""Texts whose five-word shingles are alike: minimum hashes propose, exact similarity decides.

A text's signature is ``BANDS`` keys of ``HASHES`` minimum hashes each. Two texts of
similarity s have a key in common with probability 1 - (1 - s^HASHES)^BANDS: all but one in
twenty million at 0.8. Every link is verified on the shingles themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from meterloom.llm.common import checkpointed, compact, components, ship

ship(__name__)

WIDTH = 5
BANDS, HASHES = 32, 4
LONGS = 16  # of the bit set of shingles
ROUNDS = 2  # of single comparisons, where buckets are large
TEXTS = 2_000  # pairs to compare, or texts, in a partition
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd
_random = np.random.default_rng(42)
MULTIPLY = _random.integers(0, 1 << 64, size=(BANDS * HASHES, 1), dtype=np.uint64) | np.uint64(1)
ADD = _random.integers(0, 1 << 64, size=(BANDS * HASHES, 1), dtype=np.uint64)
#: Buckets of the filter that keeps texts without a candidate from moving; its size is this, whatever the input.
BUCKETS = 1 << 19


def text_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # as in simhash


def shingles(text: str, width: int = WIDTH) -> set[bytes]:
    """Distinct word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text_words(text)
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a: str, b: str, least: float, width: int = WIDTH) -> bool:
    """Shared shingles are ``least`` or more of all shingles of the two texts."""
    x, y = shingles(a, width), shingles(b, width)
    both = len(x & y)
    return both > 0 and both >= least * (len(x) + len(y) - both) - 1e-9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def signature(text: str, width: int = WIDTH) -> tuple[int, list[int], list[int]]:
    """(number of distinct shingles, band keys, bit set of the shingles) as signed longs; no words: (0, [], [])."""
    import xxhash

    words = text_words(text)
    if not words:
        return 0, [], []
    w = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - width + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(min(width, len(w))):
        h = h * BASE + w[i : i + n]
    h = np.unique(_mixed(h))
    low = np.full(BANDS * HASHES, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(h), 2048):  # memory doesn't grow with the text
        low = np.minimum(low, (h[at : at + 2048] * MULTIPLY + ADD).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, HASHES).T:
        key = _mixed(key * BASE + column)
    bits = np.zeros(64 * LONGS, dtype=np.uint8)
    bits[h % np.uint64(64 * LONGS)] = 1
    return len(h), key.view(np.int64).tolist(), np.packbits(bits).view(np.int64).tolist()


def _bucket(row: str) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(BUCKETS)).cast("int")


def verified(pairs: DataFrame, rows: DataFrame, least: float, width: int = WIDTH) -> DataFrame:
    """The (a, b) of ``pairs`` (row, other, a, b) whose texts are alike. ``rows`` has (row, text)."""
    pairs = compact(checkpointed(pairs), TEXTS)
    wanted = pairs.select("row").union(pairs.select("other")).distinct()
    # At most BUCKETS numbers are broadcast; texts in other buckets stay where they are.
    buckets = wanted.select(_bucket("row").alias("bucket")).distinct()
    near = rows.withColumn("bucket", _bucket("row")).join(F.broadcast(buckets), "bucket", "left_semi").select("row", "text")
    texts = compact(checkpointed(near.join(wanted, "row", "left_semi").dropDuplicates(["row"])), TEXTS)

    @pandas_udf("boolean")
    def same(x, y):
        import pandas as pd

        return pd.Series([alike(a, b, least, width) for a, b in zip(x, y, strict=True)], dtype=bool)

    other = texts.select(F.col("row").alias("other"), F.col("text").alias("text2"))
    return pairs.join(texts, "row").join(other, "other").filter(same("text", "text2")).select("a", "b")


def alike_links(found: DataFrame, rows: DataFrame, known: DataFrame, least: float, width: int = WIDTH, small: int = 64) -> DataFrame:
    """Links (a, b) that join the nodes of texts that are alike, besides ``known`` links (a, b).

    ``found`` has (node, row, size, bands, bits) for each distinct text, ``rows`` (row, text).
    Texts that links join already aren't compared. Where buckets have more than ``small``
    texts, rounds come first: a text is compared with one text of its largest bucket, drawn
    anew each round, so a large group of copies joins at a comparison a text and round. All
    pairs that share a bucket and aren't joined by then are compared; none is skipped.
    """
    keyed = found.select("node", "row", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    shared = compact(checkpointed(keyed.join(sizes.filter("low < high").select("key", "n"), "key").join(found.select("row", "size", "bits"), "row")))

    def fits(x: str, y: str) -> Column:
        """True of all pairs that are alike: their sizes are as close, and shingles that only one of
        the two has are so few; every bit that differs is one of these at least."""
        sizes = F.least(f"{x}.size", f"{y}.size") >= F.greatest(f"{x}.size", f"{y}.size") * least - 1e-6
        differ = [F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(LONGS)]
        most = (F.col(f"{x}.size") + F.col(f"{y}.size")) * ((1 - least) / (1 + least)) + 1e-6
        return sizes & (sum(differ[1:], differ[0]) <= most)

    def labelled(links: DataFrame) -> DataFrame:
        """Members of the buckets that links don't join to one, with the label of what they are joined to."""
        joined = components(links)
        marked = shared.join(joined, shared["node"] == joined["node"], "left").select(
            "key", "n", shared["node"], "row", "size", "bits", F.coalesce("component", shared["node"]).alias("label")
        )
        marked = compact(checkpointed(marked))
        ends = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        return marked.join(ends.filter("low < high").select("key"), "key", "left_semi")

    links = known.select("a", "b").limit(0)
    members = shared.withColumn("label", F.col("node"))
    if not shared.filter(F.col("n") > small).isEmpty():
        for turn in range(ROUNDS):
            members = compact(checkpointed(labelled(known.select("a", "b").unionByName(links))))
            crowd = members.filter(F.col("n") > small)
            if _open_pairs(crowd) <= small * crowd.select("row").distinct().count():
                break
            drawn = crowd.groupBy("key").agg(F.min_by(F.struct("row", "node", "size", "bits", "label"), F.xxhash64("key", "row", F.lit(turn))).alias("of"))
            own = crowd.groupBy("row").agg(F.max_by(F.struct("key", "node", "size", "bits", "label"), F.struct("n", "key")).alias("my")).select("row", "my.*")
            stars = own.alias("x").join(drawn.select("key", "of.*").alias("y"), "key").filter("x.label <> y.label").filter(fits("x", "y"))
            pairs = stars.select("x.row", F.col("y.row").alias("other"), F.col("x.node").alias("a"), F.col("y.node").alias("b"))
            links = links.unionByName(compact(checkpointed(verified(pairs, rows, least, width))))
        else:
            members = compact(checkpointed(labelled(known.select("a", "b").unionByName(links))))
    rest = members.alias("x").join(members.alias("y"), "key").filter("x.row < y.row AND x.label <> y.label").filter(fits("x", "y")).select(
        "x.row", F.col("y.row").alias("other"), F.col("x.node").alias("a"), F.col("y.node").alias("b")
    )
    return links.unionByName(verified(rest.distinct(), rows, least, width))


def _open_pairs(members: DataFrame) -> int:
    """Pairs of one bucket with different labels."""
    each = members.groupBy("key", "label").agg(F.count("*").alias("k"))
    pairs = each.groupBy("key").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("p"))
    return int(pairs.agg(F.sum("p")).first()[0] or 0)
