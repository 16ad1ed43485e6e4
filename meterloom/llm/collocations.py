"""Phrase collocations by partitions: each shard is mined at a lowered support, the union of what is
frequent anywhere is counted exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterloom.llm.common import ship, stored

ship(__name__)

#: A-Z to a-z, tabs to spaces, and what ends a piece to a byte that UTF-8 never has.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: Filters have up to 2**27 bits (16 MB), however many phrases there are.
MOST_BITS = 27
#: Places that a task mines at a time.
MINED_PLACES = 1 << 20
CODEC = "zstd"
#: Of the hash of a phrase, put together from those of its words.
FACTOR, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
PACKED = ("words", "words_bytes", "numbers", "n_numbers")
#: Languages of which a row each may be broadcast; with more of them the rows meet by a shuffle.
FEW_LANGS = 10_000
#: Rows of a batch that is read or written at a time.
BATCH_ROWS, TEXT_ROWS = 1 << 16, 256


@dataclass
class Bits:
    """A set of hashes as a bit per leading ``size`` bits: what is in the set is in the filter."""

    size: int
    words: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.size)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def bits_of(hashes: DataFrame) -> Bits:
    """A filter of the column ``h``, sized by the number of rows up to ``MOST_BITS``."""
    size = min(max((16 * hashes.count()).bit_length(), 16), MOST_BITS)
    at = F.shiftrightunsigned("h", 64 - size)
    words = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - size}) & 63 as int))")).alias("bits")
    )
    found = words.toArrow()
    out = np.zeros(1 << (size - 6), dtype=np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return Bits(size, out.view(np.uint64))


def encoded(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """(words, numbers): the text as numbers of its words from 1; 0 ends a piece."""
    tokens = [b"\xff", *text.translate(LETTERS).replace(b"\xff", b" \xff ").split()]
    numbered = pa.array(tokens, pa.binary()).dictionary_encode()
    return numbered.dictionary.slice(1).cast(pa.string()), numbered.indices.to_numpy()


def blocks(docs: DataFrame, block_bytes: int = 4 << 20, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """part, lang, words, words_bytes, numbers, n_numbers, n_words: texts as numbers, a row per language of
    about ``block_bytes`` of whole texts (a longer text is a block of its own). Stored: the levels read it
    instead of the texts. Words and numbers are packed, so that what a task is sent is as small as the
    file, and it unpacks one block at a time."""
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[str, list[bytes]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                words, numbers = encoded(b"\xff".join(texts))
                spelled = " ".join(words.to_pylist()).encode()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([lang]),
                     pa.array([pa.compress(spelled, CODEC, asbytes=True)], pa.binary()), pa.array([len(spelled)], pa.int64()),
                     pa.array([pa.compress(numbers.astype("<i4").tobytes(), CODEC, asbytes=True)], pa.binary()),
                     pa.array([len(numbers)], pa.int64()), pa.array([int((numbers > 0).sum())], pa.int64())],
                    names=["part", "lang", "words", "words_bytes", "numbers", "n_numbers", "n_words"],
                )

        for batch in pieces(batches, TEXT_ROWS):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if size + len(text) > block_bytes and held:
                    yield from out()
                    held, size = {}, 0
                held.setdefault(lang, []).append(text)
                size += len(text) + 1
        yield from out()

    schema = "part int, lang string, words binary, words_bytes long, numbers binary, n_numbers long, n_words long"
    return stored(rows.mapInArrow(run, schema), "phrase-blocks")


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``rows`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Block:
    """A stored block with a 64-bit hash of each word, seeded by its language."""

    def __init__(self, lang: str, words: list[str], numbers: bytes):
        import xxhash

        seed = xxhash.xxh64_intdigest(lang)
        self.lang, self.words, self.numbers = lang, words, np.frombuffer(numbers, dtype="<i4")
        self.hashes = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words)], dtype=np.uint64)

    def phrases(self, length: int, filters: list[Bits]) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of phrases within pieces whose parts of 1, 2 ... words pass the filters."""
        word = self.hashes[self.numbers]
        here, ok = word, self.numbers > 0
        for n in range(1, length + 1):
            if n > 1:
                ok = ok[:-1] & ok[1:]
                here = here[:-1] * np.uint64(FACTOR)
                here = (here ^ (here >> np.uint64(32))) + word[n - 1 :]
            if n <= len(filters):
                ok = ok.copy()
                ok[ok] = filters[n - 1].has(here[ok])
        places = np.nonzero(ok)[0]
        return places, here[places]

    def counted(self, length: int, filters: list[Bits]) -> pa.RecordBatch:
        """Exact counts of the block's phrases, told apart by their words, not by hashes."""
        places, _ = self.phrases(length, filters)
        base = len(self.words) + 1
        key = self.numbers[places].astype(np.int64)
        for k in range(1, length):
            if k > 1:  # numbers of the shorter phrases instead of the numbers of all their words
                key = np.unique(key, return_inverse=True)[1]
            key = key * base + self.numbers[places + k]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        spelled = [self.numbers[places[first] + k].tolist() for k in range(length)]
        phrases = [" ".join([self.words[i - 1] for i in p]) for p in zip(*spelled, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * len(n), pa.string()), pa.array(phrases, pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"]
        )


def _blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    """One block after another, so that one is held as Python objects at a time."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        words = pa.decompress(row["words"], row["words_bytes"], CODEC, asbytes=True).decode()
        yield Block(row["lang"], words.split(" ") if words else [], pa.decompress(row["numbers"], 4 * row["n_numbers"], CODEC, asbytes=True))


def counts(parts: DataFrame, length: int, filters: list[Bits]) -> DataFrame:
    """lang, phrase, f: all occurrences of the phrases that pass the filters, counted over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks_of(batch):
                yield from pieces([block.counted(length, filters)], BATCH_ROWS)

    found = parts.select("lang", *PACKED).mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def hashed(phrases: DataFrame) -> DataFrame:
    """lang, phrase, f with ``h``, the hash that ``Block.phrases`` gives the phrase. Made for what is left
    after counting, so that it need not move with every local count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = xxhash.xxh64_intdigest(lang)
                h = None
                for word in phrase.split(" "):
                    own = xxhash.xxh64_intdigest(word, seed)
                    h = own if h is None else (_mix(h) + own) & MASK
                out.append(h)
            made = pa.array(np.array(out, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=["lang", "phrase", "f", "h"])

    return phrases.select("lang", "phrase", "f").mapInArrow(run, "lang string, phrase string, f long, h long")


def _mix(h: int) -> int:
    h = h * FACTOR & MASK
    return h ^ h >> 32


def mined(parts: DataFrame, length: int, filters: list[Bits], supports: dict[int, int]) -> DataFrame:
    """The hashes (h) of all phrases that are frequent in some shard, by the shard's own support.

    A shard is a fixed part of the blocks, mined whole: its tasks count their blocks, the counts of
    a shard are added up. Hashes that collide only make a candidate too many.
    """
    shards = len(supports)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for shard, hashes in held.items():
                h, n = np.unique(np.concatenate(hashes), return_counts=True)
                local = pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), shard, dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["shard", "h", "n"],
                )
                yield from pieces([local], BATCH_ROWS)

        for batch in batches:
            for shard, block in zip(batch.column("part").to_pylist(), _blocks_of(batch), strict=True):
                found = block.phrases(length, filters)[1]
                if held and size + len(found) > MINED_PLACES:
                    yield from out()
                    held, size = {}, 0
                held.setdefault(shard % shards, []).append(found)
                size += len(found)
        yield from out()

    local = parts.select("part", "lang", *PACKED).mapInArrow(run, "shard int, h long, n long")
    # A task's own counts are added up already, so they move first and meet one hash table, not two.
    of_shard = local.repartition("shard", "h").groupBy("shard", "h").agg(F.sum("n").alias("n"))
    least = F.element_at(F.array(*[F.lit(supports[s]) for s in range(shards)]), F.col("shard") + 1)
    return of_shard.filter(F.col("n") >= least).select("h").distinct()


def frequent_phrases(docs: DataFrame, support: int = 10, longest: int = 3, shards: int = 2, block_bytes: int = 4 << 20,
                     lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words with at least ``support`` occurrences,
    and (lang, n) of all word occurrences. Both stored.

    The support of a shard is its share of all words, rounded up: a phrase that is below it in
    every shard is below ``support`` in all. With more shards than ``support`` it would be one
    occurrence and rule out nothing, so a shard is a large part of the table, mined by many tasks.
    Longer phrases are looked for only where their parts are frequent.
    """
    parts = blocks(docs, block_bytes, lang_col, text_col)
    share = dict(parts.groupBy(F.col("part") % shards).agg(F.sum("n_words")).collect())
    total = max(sum(share.values()), 1)
    supports = {s: max(1, -(-support * share.get(s, 0) // total)) for s in range(shards)}
    sizes = stored(parts.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-totals")
    filters: list[Bits] = []
    levels = []
    for length in range(1, longest + 1):
        # Words are counted outright: their local counts are the exact ones, and fewer than the blocks' words.
        candidates = [bits_of(stored(mined(parts, length, filters, supports), "phrase-candidates"))] if length > 1 else []
        level = counts(parts, length, filters + candidates).filter(F.col("f") >= support)
        level = stored(hashed(level).withColumn("words", F.lit(length)), f"phrases-{length}")
        levels.append(level.select("lang", "phrase", "words", "f"))
        filters.append(bits_of(level))
    return reduce(DataFrame.unionByName, levels), sizes


def collocations(
    docs: DataFrame,
    support: int = 10,
    longest: int = 3,
    most: int = 2000,
    absorbed: int = 50,
    shards: int = 2,
    block_bytes: int = 4 << 20,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of 2 to ``longest`` words of each language.

    A-Z are lowered; texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words
    at spaces and tabs. A phrase with ``a`` occurrences (``support`` or more), cut after some word,
    scores floor(1000000 * a * a / (l * r)) by the occurrences of both sides; its lowest cut
    counts. It is dropped if a longer candidate holds it and has ``absorbed`` percent of its
    occurrences or more. Null languages are ``und``, null texts empty; repeated rows count again;
    a table without words gives no rows. Other columns play no part.
    """
    found, sizes = frequent_phrases(docs, support, longest, shards, block_bytes, lang_col, text_col)
    split = F.split("phrase", " ")
    long = found.filter("words > 1").withColumn("w", split)

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cut = long.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words")).alias("right"))
    l = found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    r = found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = [F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r")]
    sides = cut.join(l, ["lang", "left"]).join(r, ["lang", "right"]).withColumns({"a2": wide[0] * wide[0], "lr": wide[1] * wide[2]})
    score = F.expr("cast((cast(1000000 as decimal(7,0)) * a2) div lr as bigint)")
    lowest = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))

    # Every shorter phrase inside a longer one, with the most occurrences of a longer one.
    inner = long.filter("words > 2").select("lang", "w", "f", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "w", "f", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    inner = inner.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))

    ranked = _within_reach(stored(kept.select("lang", "phrase", "a", "c.*"), "collocations"), most)
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = ranked.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= most)
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _within_reach(rows: DataFrame, most: int) -> DataFrame:
    """The rows of each language that can be among its ``most`` best, and few more.

    Scores fold to a histogram of steps of less than a hundredth, some two thousand a language; rows
    below the step that fills the list go before any language comes together in a task.
    """
    step = F.floor(100 * F.log2(F.col("score") + 1)).cast("int")
    steps = rows.groupBy("lang", step.alias("step")).agg(F.count("*").alias("k"))
    above = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    bars = steps.withColumn("above", F.coalesce(above, F.lit(0))).filter(F.col("above") < most).groupBy("lang").agg(F.min("step").alias("bar"))
    bars = stored(bars, "bars")
    return rows.join(F.broadcast(bars) if bars.count() <= FEW_LANGS else bars, "lang").filter(step >= F.col("bar")).drop("bar")


#: The contract's query in SQL.
ORACLE = """
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS body
    FROM documents),
word AS (SELECT lang, list_filter(regexp_split_to_array(body, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM word GROUP BY lang),
every AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
          FROM word, unnest([1, 2, 3]) AS s(size), unnest(range(1, len(w) - size + 2)) AS p(i)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM every GROUP BY ALL),
candidate AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cut AS (
    SELECT c.lang, c.phrase, c.size, c.a, k, l.a AS l, r.a AS r,
           CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.size], ' ')
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidate WHERE size = 3) GROUP BY ALL),
ranked AS (
    SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, c.a DESC, c.phrase) AS rank
    FROM cut c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase AND c.size = 2
    WHERE o.most IS NULL OR 100 * o.most < 50 * c.a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN total USING (lang) WHERE rank <= 2000"""
