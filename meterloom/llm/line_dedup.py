"""Line deduplication: a deletion-neighbourhood join on words.

Lines are compared as word sequences. A line is removed if an earlier one has the same
words or, from five words on, is one word away (one put in, left out or replaced). The
bound is one word however long the line is: longer lines that differ in two words or more
stay, also at a similarity of 0.8 or more. Earlier: smaller (doc_id, line number).

Two lines one word apart share the words before the edit or those after it, hence a
prefix or a suffix of a length that both know. Only lines that share such a key with
another line emit their deletion variants; variants are hashed and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from meterloom.llm.common import checkpointed, ship, text_rows, unused

ship(__name__)

LEAST_WORDS = 5
KEYS = ("prefix", "suffix", "prefix_1", "suffix_1")
ID = ["h1", "h2"]
#: Odd, for polynomial hashes modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def shared_length(n: int) -> int:
    """Words of the prefix and suffix keys for a pair whose shorter line has ``n`` words:
    the largest power of two up to n / 2."""
    return 1 << ((n // 2).bit_length() - 1) if n >= 2 else 0


def keys_of(words: list[bytes]) -> list[int | None]:
    """Prefix and suffix keys of a line as the shorter or equal of a pair, then as the longer
    (None where the length is the same). An edit beyond the prefix leaves the prefix equal;
    one in it leaves at least as many words at the end equal."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    own, other = shared_length(len(words)), shared_length(len(words) - 1)

    def pair(n: int) -> list[int]:
        return [h(b"p " + b" ".join(words[:n])), h(b"s " + b" ".join(words[-n:]))]

    found = pair(own) + (pair(other) if other != own else [None, None])
    return [None if k is None else k - (1 << 64) if k >> 63 else k for k in found]


def variants(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Hashes of the line without its i-th word, for each i, and of the whole line: polynomial
    hashes put together from sums over the words before and after, linear in the line."""
    import xxhash

    w = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words), dtype=np.uint64, count=len(words))
    power = np.ones(len(w) + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(len(w), BASE), out=power[1:])
    before = np.concatenate([[np.uint64(0)], np.cumsum(w * power[:-1], dtype=np.uint64)])
    after = np.concatenate([[np.uint64(0)], np.cumsum((w[1:] * power[:-2])[::-1], dtype=np.uint64)])[::-1]
    left = before[:-1] + after
    return _mixed(left).view(np.int64), int(_mixed(before[-1:]).view(np.int64)[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def one_word_apart(a: list, b: list) -> bool:
    """Word edit distance of at most 1, by common beginning and end."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    s = 0
    while s < n - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def line_words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").split()


def lines_of(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, row, line, n, h1, h2, keys): a row for each line with words; ``row`` is a hash of the
    text, so that rows of one doc_id are told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            place, number, n, h1, h2 = [], [], [], [], []
            keys: list[list] = [[], [], [], []]
            for i, text in enumerate(batch.column(2).to_pylist()):
                for j, line in enumerate(text.split("\n")):
                    words = line_words(line)
                    if not words:
                        continue
                    d = xxhash.xxh3_128_digest(b" ".join(words))
                    place.append(i)
                    number.append(j)
                    n.append(len(words))
                    h1.append(d[:8])
                    h2.append(d[8:])
                    for column, k in zip(keys, keys_of(words) if len(words) >= LEAST_WORDS else [None] * 4, strict=True):
                        column.append(k)
            at = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(n, pa.int32()),
                 *(pa.array(np.frombuffer(b"".join(h), dtype="<i8"), pa.int64()) for h in (h1, h2)),
                 *(pa.array(k, pa.int64()) for k in keys)],
                names=["doc_id", "row", "line", "n", *ID, *KEYS],
            )

    return rows.select("doc_id", "row", "text").mapInArrow(
        run, f"doc_id {kind}, row long, line int, n int, h1 long, h2 long, " + ", ".join(f"{k} long" for k in KEYS)
    )


PLACE = ["doc_id", "row", "line"]
#: Buckets of the filter that keeps texts without eligible lines from moving; its size is this, whatever the input.
BUCKETS = 1 << 19


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id", "row"), F.lit(BUCKETS)).cast("int")


def eligible_texts(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(lid, words): distinct lines that share a key with another; lid grows with the line's place.

    ``firsts`` has a row for each distinct line, so a key that occurs twice is shared by two
    lines; a key of very many lines folds to a count, and the join back adds no pairs.
    """
    keyed = firsts.filter(F.col("n") >= LEAST_WORDS).select(*PLACE, F.explode(F.array(*KEYS)).alias("key")).filter("key IS NOT NULL")
    shared = keyed.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    eligible = keyed.join(shared, "key").select(*PLACE).distinct()
    wanted = checkpointed(eligible.groupBy("doc_id", "row").agg(F.collect_list("line").alias("lines")))
    # Texts in buckets without any wanted line stay where they are: at most BUCKETS numbers are broadcast.
    buckets = wanted.select(_bucket().alias("bucket")).distinct()
    near = rows.withColumn("bucket", _bucket()).join(F.broadcast(buckets), "bucket", "left_semi")
    same = F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.row") == F.col("w.row"))
    found = near.alias("r").join(wanted.alias("w"), same).select(
        "r.doc_id", "r.row", F.split("text", "\n").alias("all"), F.explode("lines").alias("line")
    )
    each = found.select(*PLACE, F.get("all", F.col("line")).alias("words")).dropDuplicates(PLACE)
    return checkpointed(each.orderBy(*PLACE).select(F.monotonically_increasing_id().alias("lid"), *PLACE, "words"))


def emit_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lid, words) -> (variant, at, lid): a row for each word left out, and one (at -1) for the whole
    line; some ten thousand rows at a time, however long the lines."""
    for batch in batches:
        lids, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        value, at, of, made = [], [], [], 0
        for lid, line in zip(lids, lines, strict=True):
            without, whole = variants(line_words(line))
            value += [without, np.array([whole])]
            at += [np.arange(len(without)), np.array([-1])]
            of.append(np.full(len(without) + 1, lid))
            made += len(without) + 1
            if made > 50_000:
                yield _variant_batch(value, at, of)
                value, at, of, made = [], [], [], 0
        if made:
            yield _variant_batch(value, at, of)


def _variant_batch(value: list, at: list, of: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(value), pa.int64()), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(of), pa.int64())],
        names=["variant", "at", "lid"],
    )


def near_lines(texts: DataFrame) -> DataFrame:
    """Places of the distinct lines that are one word from an earlier one."""
    emitted = texts.select("lid", "words").mapInArrow(emit_variants, "variant long, at int, lid long")
    left = emitted.filter("at >= 0")
    # Replaced word: the same variant without the same place. The earliest line of the group is the partner of all others.
    earliest = left.groupBy("variant", "at").agg(F.min("lid").alias("p"), F.count("*").alias("k")).filter("k > 1").drop("k")
    replaced = left.join(earliest, ["variant", "at"]).filter("lid > p").select("lid", "p")
    # A word more: the variant is another line as a whole. Either of the two may be the earlier.
    whole = emitted.filter("at < 0").select("variant", F.col("lid").alias("w"))
    pairs = left.select("variant", "lid").join(whole, "variant").filter("lid <> w")
    one_more = pairs.select(F.greatest("lid", "w").alias("lid"), F.least("lid", "w").alias("p"))
    partner = replaced.unionByName(one_more).groupBy("lid").agg(F.min("p").alias("p"))

    @pandas_udf("boolean")
    def verified(x, y):
        import pandas as pd

        return pd.Series([one_word_apart(line_words(a), line_words(b)) for a, b in zip(x, y, strict=True)])

    other = texts.select(F.col("lid").alias("p"), F.col("words").alias("other"))
    return texts.join(partner, "lid").join(other, "p").filter(verified("words", "other")).select(*PLACE)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, exact, near): the numbers of the lines to remove, for texts that have any.

    ``row`` is xxhash64 of the text. Rows without doc_id come first. Rows with the same id
    and text are one document: they don't repeat each other's lines, and get one result.
    """
    rows = text_rows(docs, id_col=id_col, text_col=text_col).withColumn("row", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    lines = lines_of(rows, kind)
    # Equal lines fold in each task first: a line that a third of all texts have is a row a task.
    folded = lines.groupBy(*ID).agg(
        F.min(F.struct(*PLACE)).alias("place"), F.first("n").alias("n"), F.count("*").alias("times"),
        *[F.first(k).alias(k) for k in KEYS],
    )
    firsts = checkpointed(folded.select(*ID, "place.*", "n", "times", *KEYS))
    near = checkpointed(near_lines(eligible_texts(rows, firsts)))
    # Lines that occur once and have no near one are done; the others meet all their places.
    same = [firsts[c].eqNullSafe(near[c]) for c in PLACE]
    close = firsts.join(near.withColumn("near", F.lit(True)), same, "left").select(
        *ID, F.struct(*[firsts[c] for c in PLACE]).alias("first"), "times", "near"
    )
    state = close.filter("near OR times > 1").drop("times")
    gone = (
        lines.select(*ID, *PLACE).join(state, ID).filter("near OR NOT (struct(doc_id, row, line) <=> first)")
    )
    return gone.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_set(F.when(F.col("near").isNull(), F.col("line")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(F.col("near"), F.col("line")))).alias("near"),
    )


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the text without repeated lines, all other columns as they were.

    Null and empty texts and blank lines stay. ``drop_emptied`` leaves out texts that had
    words and have none left: they only repeated earlier ones.
    """
    own, its_id, its_row, lines = (unused(docs, n) for n in ("__own", "__id", "__row", "__gone"))
    gone = repeated_lines(docs, id_col, text_col).select(
        F.col("doc_id").alias(its_id), F.col("row").alias(its_row), F.array_union("exact", "near").alias(lines)
    )
    text = F.col(f"`{text_col}`")
    keyed = docs.select("*", F.xxhash64(F.coalesce(text, F.lit(""))).alias(own))
    joined = keyed.join(gone, keyed[id_col].eqNullSafe(gone[its_id]) & (keyed[own] == gone[its_row]), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.col(lines), i)), "\n")
    changed = joined.withColumn(text_col, F.when(F.col(lines).isNull(), text).otherwise(kept))
    if drop_emptied:
        changed = changed.filter(F.col(lines).isNull() | text.rlike(r"\S"))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])
