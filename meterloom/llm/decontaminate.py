"""Benchmark decontamination over a stored positional inverted index of the training words.

``build_index`` cuts the documents into shards and stores, per shard, every word's sorted
positions. ``search`` reads the stored shards: for each window of a test item it takes the
positions of the window's rarest words in the shard, moves them back by the word's offset,
and intersects, rarest first. Three words that agree within a slop are a proximity match;
all words that agree exactly are an occurrence of the phrase.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterloom.llm.common import checkpointed, ship, stored, text_rows, unused, words_of

ship(__name__)

WINDOW = 13
SLOP = 3
#: Positions between two documents of a shard, so that no match crosses from one to the next.
GAP = 64
RARE = 4  # words of a window whose postings are intersected for a proximity match


def packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype="<u4").astype(np.int64)


def shard_row(ids: list, texts: list[str]) -> tuple:
    """Postings of a shard: sorted terms, their numbers of positions, and the gaps between positions."""
    number: dict[bytes, int] = {}
    n_words, parts, bases, base = [], [], [], 0
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)))
        bases.append(base)
        n_words.append(len(words))
        base += len(words) + GAP
    terms = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    places = np.concatenate([b + np.arange(n, dtype=np.int64) for b, n in zip(bases, n_words, strict=True)]) if parts else terms
    order = np.argsort(terms, kind="stable")
    counts = np.bincount(terms, minlength=len(number))
    sorted_places = places[order]
    gaps = np.diff(sorted_places, prepend=0)
    starts = np.cumsum(counts) - counts
    gaps[starts] = sorted_places[starts]
    return ids, n_words, zlib.compress(b"\n".join(number), 1), packed(counts), packed(gaps)


def build_index(docs: DataFrame, shard_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index, stored in the cluster's shared folder: a row per shard.

    A shard has whole documents of about ``shard_bytes`` characters (a longer document is a
    shard of its own) and is independent of any benchmark. Null and empty texts are in it
    without words; repeated rows are documents of their own.
    """
    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        schema = None

        def row():
            ids_, n, terms, counts, gaps = shard_row(ids, texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids_], pa.list_(schema.field(0).type)), pa.array([n], pa.list_(pa.int32())),
                 pa.array([terms], pa.binary()), pa.array([counts], pa.binary()), pa.array([gaps], pa.binary())],
                names=["doc_ids", "n_words", "terms", "counts", "gaps"],
            )

        for batch in batches:
            schema = batch.schema
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and size + len(text) > shard_bytes:
                    yield row()
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids:
            yield row()

    stored = rows.mapInArrow(run, f"doc_ids array<{kind}>, n_words array<int>, terms binary, counts binary, gaps binary")
    return checkpointed(stored.select(F.monotonically_increasing_id().alias("shard"), "*"))


@dataclass
class Tests:
    """A block of test items: its terms, and a row of term numbers for each window."""

    terms: list[bytes]
    names: list[str]  # of items
    windows: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> (item of each window, its terms)


def test_block(items: list[tuple[str, str]], width: int) -> Tests:
    number: dict[bytes, int] = {}
    names: list[str] = []
    by_length: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for name, text in items:
        words = [number.setdefault(w, len(number)) for w in words_of(text or "")]
        if not words:
            continue
        names.append(name)
        n = min(width, len(words))
        found = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        by_length.setdefault(n, []).extend((len(names) - 1, w) for w in sorted(found))
    windows = {
        n: (np.array([i for i, _ in rows]), np.array([w for _, w in rows], dtype=np.int64)) for n, rows in by_length.items()
    }
    return Tests(list(number), names, windows)


def matches(tests: Tests, terms: bytes, counts: bytes, gaps: bytes, slop: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(item, length, starts of exact matches, places of a proximity match's rarest word) of a shard's postings."""
    at = {t: i for i, t in enumerate(zlib.decompress(terms).split(b"\n"))}
    n_of, steps = unpacked(counts), unpacked(gaps)
    ends = np.cumsum(n_of)
    local = np.array([at.get(t, -1) for t in tests.terms], dtype=np.int64)
    known = local >= 0
    if not known.any() or not len(n_of):
        return
    size = np.where(known, n_of[local], 0)
    lists: dict[int, np.ndarray] = {}

    def postings(term: int) -> np.ndarray:
        if term not in lists:
            i = local[term]
            lists[term] = np.cumsum(steps[ends[i] - n_of[i] : ends[i]])
        return lists[term]

    def close(starts: np.ndarray, term: int, offset: int, reach: int) -> np.ndarray:
        """Starts that the term's offset-adjusted postings have within ``reach``."""
        p = postings(term)
        k = np.searchsorted(p, starts + (offset - reach))
        return starts[(k < len(p)) & (p[np.minimum(k, len(p) - 1)] <= starts + (offset + reach))]

    for n, (item, rows) in tests.windows.items():
        sizes = size[rows]
        for w in np.flatnonzero(sizes.min(axis=1) > 0):
            row, rare = rows[w], np.argsort(sizes[w], kind="stable")
            near = postings(row[rare[0]]) - rare[0]
            for j in rare[1:RARE]:
                near = close(near, row[j], j, slop)
                if not len(near):
                    break
            if not len(near):
                continue
            exact = near[near >= 0]
            for j in rare[1:]:
                exact = close(exact, row[j], j, 0)
                if not len(exact):
                    break
            # The start may lie before the document, even in the one before; the word is in it.
            yield int(item[w]), n, exact, near + rare[0]


def search_shard(tests: Tests, n_words: list[int], terms: bytes, counts: bytes, gaps: bytes, slop: int) -> list[tuple]:
    """Per document of a shard: (items, spans of hit words, items near)."""
    n = np.array(n_words, dtype=np.int64)
    bases = np.cumsum(n + GAP) - (n + GAP)
    items: list[set[str]] = [set() for _ in n_words]
    near: list[set[str]] = [set() for _ in n_words]
    spans: list[list[tuple[int, int]]] = [[] for _ in n_words]
    for item, length, exact, close in matches(tests, terms, counts, gaps, slop):
        for found, into in ((exact, items), (close, near)):
            for d in np.unique(np.searchsorted(bases, found, side="right") - 1).tolist():
                into[d].add(tests.names[item])
        for d, start in zip((np.searchsorted(bases, exact, side="right") - 1).tolist(), exact.tolist(), strict=True):
            spans[d].append((start - int(bases[d]), start - int(bases[d]) + length))
    return [(sorted(i), merged(s), sorted(m)) for i, s, m in zip(items, spans, near, strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def search(
    index: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = SLOP, block_bytes: int = 8 << 20,
    item_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, near_items) for every document of the index.

    ``items`` are the item names whose windows occur, as strings; ``spans`` the hit words
    (start, end) by word number; ``near_items`` have the rarest words of a window within
    ``slop`` words of their places. Items go to the tasks in blocks of about
    ``block_bytes``, one after another, so neither a task's nor the driver's memory grows with the
    benchmark; each block reads the stored index, not the documents, and stores what it found. Items without words match nothing; an item without
    a name is called "null"; items of one name count once.
    """
    tests = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    total = tests.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def hits(block: Tests) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    shard, _, n, *lists = (one.column(c).to_pylist()[0] for c in range(6))
                    found = search_shard(block, n, *lists, slop)
                    ids = one.column(1).flatten()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(n), pa.int64()), pa.array(range(len(n)), pa.int32()), ids, pa.array(n, pa.int64()),
                         pa.array([f[0] for f in found], pa.list_(pa.string())),
                         pa.array([[{"start": s, "end": e} for s, e in f[1]] for f in found], span),
                         pa.array([f[2] for f in found], pa.list_(pa.string()))],
                        names=["shard", "place", "doc_id", "n_words", "items", "spans", "near_items"],
                    )

        return index.mapInArrow(
            run,
            f"shard long, place int, doc_id {kind}, n_words long, items array<string>, "
            "spans array<struct<start: int, end: int>>, near_items array<string>",
        )

    found = None
    for b in range(blocks):
        rows = tests.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b).collect()
        part = hits(test_block([(r["name"], r["text"]) for r in rows], width))
        if blocks > 1:  # run now: the plan of the union reads what was found, and holds no block
            part = stored(part, "hits")
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        # Spans of several blocks overlap: sort, then carry (end so far, words so far) over them.
        found = found.groupBy("shard", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    n_hit = F.aggregate(
        "spans", start,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", "near_items")


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``contaminated``: hit words are a ``share``-th of all words or more."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; rows of one id are judged by their own texts."""
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("row"))
    name = unused(docs, "__key")
    keyed = docs.withColumn(name, key)
    index = build_index(keyed, id_col=name, text_col=text_col)
    bad = judged(search(index, items)).filter("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    same = keyed[name]["id"].eqNullSafe(bad["bad"]["id"]) & (keyed[name]["row"] == bad["bad"]["row"])
    return keyed.join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
