"""Document fingerprints from Lempel-Ziv phrases: parse, hash the phrase set, keep minimum hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from meterloom.llm.common import ship, text_rows

ship(__name__)

#: Bins of the signature; each keeps one byte of its least hash.
BINS = 128


def phrases(text: str, start: int, stop: int, known: set[str], length: int) -> tuple[list[str], int]:
    """Dictionary phrases of ``text[start:stop]``, added to ``known``, and where the last one ends.

    A phrase is the longest string that starts here and is known, with one more character.
    Every known phrase has its prefixes known, so the length is sought from that of the last
    phrase up or down. Phrases that ``stop`` would cut are not taken; the rest is left.
    """
    new: list[str] = []
    i, k = start, max(1, length)
    while i < stop:
        p = text[i : i + k]
        if p in known:
            while p in known:
                k += 1
                if i + k > stop:
                    return new, i
                p = text[i : i + k]
        else:
            while k > 1 and (q := text[i : i + k - 1]) not in known:
                k -= 1
                p = q
            if i + k > stop:
                return new, i
        known.add(p)
        new.append(p)
        i += k
    return new, i


def hashes(found: list[str]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(p) for p in found), dtype=np.uint64, count=len(found))


def signature(hashed: np.ndarray) -> str:
    """Two hex digits a bin: the last byte of the least hash in each of BINS hash ranges.

    An empty bin takes the value of the next one that isn't, mixed with the distance, so
    short texts compare too. No phrase at all: the empty string.
    """
    if not len(hashed):
        return ""
    order = np.sort(hashed)
    bins = (order >> np.uint64(57)).astype(np.int64)
    first = np.searchsorted(bins, np.arange(BINS))
    filled = np.flatnonzero((first < len(order)) & (bins[np.minimum(first, len(order) - 1)] == np.arange(BINS)))
    value = (order[first[filled]] & np.uint64(255)).astype(np.int64)
    after = np.searchsorted(filled, np.arange(BINS)) % len(filled)
    distance = (filled[after] - np.arange(BINS)) % BINS
    return ((value[after] + 131 * distance) % 256).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal bins, less what chance makes equal: 0 to 1. Two empty signatures are alike."""
    if not a or not b:
        return float(a == b)
    same = np.mean(np.frombuffer(bytes.fromhex(a), np.uint8) == np.frombuffer(bytes.fromhex(b), np.uint8))
    return max(0.0, float((same - 1 / 256) / (1 - 1 / 256)))


def parsed(text: str) -> np.ndarray:
    """Hashes of the phrases of a whole text; what the end cuts short is a phrase too."""
    found, at = phrases(text, 0, len(text), set(), 1)
    return hashes(found + [text[at:]] * (at < len(text)))


def with_edit(text: str, nxt: str) -> tuple[str, str, str]:
    """Fingerprints of a text and of its edited text, and the edited text.

    The edit puts the beginning of ``nxt`` in the place of the last floor(n/2) characters.
    Phrases within the common beginning are parsed and hashed once.
    """
    half = len(text) - len(text) // 2
    edited = text[:half] + nxt[: len(text) // 2]
    known: set[str] = set()
    common, at = phrases(text, 0, half, known, 1)
    base = hashes(common)
    length = len(common[-1]) if common else 1
    prints = []
    for whole, seen in ((text, set(known)), (edited, known)):
        rest, end = phrases(whole, at, len(whole), seen, length)
        prints.append(signature(np.concatenate([base, hashes(rest + [whole[end:]] * (end < len(whole)))])))
    return prints[0], prints[1], edited


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row; null and empty texts have the empty fingerprint. Map only."""
    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [signature(parsed(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def in_order(docs: DataFrame, rows_a_bucket: int, most_buckets: int) -> tuple[DataFrame, int]:
    """Rows by descending doc_id in buckets, and the number of the last bucket.

    The bounds are doc_ids (quantiles, at most ``most_buckets``, all the driver gets), so the
    row that follows a bucket is the one whose doc_id is a bound. It goes to that bucket too,
    marked ``extra``: every row then meets its follower without one task seeing them all.
    Rows of one doc_id are ordered by text; rows without doc_id come last.
    """
    n = docs.filter(F.col("doc_id").isNotNull()).count()
    buckets = max(1, min(most_buckets, -(-n // rows_a_bucket)))
    shares = [i / buckets for i in range(1, buckets + 1)]
    got, top = docs.agg(F.percentile_approx("doc_id", shares, 10 * buckets + 1000), F.max("doc_id")).first()
    highest = np.array(sorted({*(got or []), *([] if top is None else [top])}, reverse=True), dtype=np.int64)  # of each bucket
    last = max(0, len(highest) - 1)

    @pandas_udf("array<int>")
    def places(ids, known):
        import pandas as pd

        ids, known = ids.to_numpy(dtype=np.int64), known.to_numpy(dtype=bool)
        at = np.searchsorted(-highest, -ids, side="right") - 1
        at = np.where(known, at, last)
        bound = known & np.isin(ids, highest)
        before = np.where(at == 0, last, at - 1)
        return pd.Series([[int(b), int(p)] if e else [int(b)] for b, p, e in zip(at, before, bound, strict=True)])

    spread = docs.select("*", F.posexplode(places(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull())).alias("extra", "bucket"))
    return (
        spread.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text"),
        last,
    )


def edit_check(
    docs: DataFrame, rows_a_bucket: int = 2048, most_buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next), a row for each row; ids are integers. The next document is the one with the
    next lower doc_id (see ``in_order`` for ties), after the last the first; a single row
    is its own next. Texts move once; a task holds two Arrow batches.
    """
    rows = text_rows(docs, id_col=id_col, text_col=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered, last = in_order(rows, rows_a_bucket, most_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        out: list[tuple] = []

        def emit(doc_id, text, nxt):
            own, changed, edited = with_edit(text, nxt)
            out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed)))

        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                            ("near_edited", pa.float64()), ("near_next", pa.float64())])

        def ready(rows_: list[tuple], following: str):
            """Rows with the likeness to the next one's fingerprint; ``following`` is that of the last one's next."""
            nexts = [r[3] for r in rows_[1:]] + [following]
            full = [(*r, likeness(r[3], f)) for r, f in zip(rows_, nexts, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*full, strict=True), schema.types, strict=True)], schema=schema
            )

        now = first = pending = None  # bucket, its first text, the row whose next isn't known
        follower = None
        for batch in batches:
            for doc_id, text, extra, bucket in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now:
                    if pending is not None:
                        nxt = follower if follower is not None else first
                        emit(*pending, nxt)
                        yield ready(out, signature(parsed(nxt)))
                        out.clear()
                    now, first, pending, follower = bucket, None, None, None
                if extra:
                    if follower is None:
                        follower = text
                    continue
                if first is None:
                    first = text
                if pending is not None:
                    emit(*pending, text)
                pending = (doc_id, text)
                if len(out) > 512:
                    keep = out.pop()
                    yield ready(out, keep[3])
                    out[:] = [keep]
        if pending is not None:
            nxt = follower if follower is not None else first
            emit(*pending, nxt)
            yield ready(out, signature(parsed(nxt)))

    return ordered.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
