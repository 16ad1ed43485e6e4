"""Byte-level BPE by overlapping chunks that are stitched where their pre-token boundaries meet."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterloom.llm.common import ship, text_rows, vocabulary

ship(__name__)

#: A boundary is certain from this many characters before the end of a chunk: the pattern
#: looks at most three characters ahead.
AHEAD = 3


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def codec(data: bytes, pattern: str) -> Callable[[str], tuple[np.ndarray, bytes]]:
    """text -> (ids, decoded bytes) for a rank file."""
    import tiktoken

    ranks = ranks_of(data)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    spelled: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        spelled[i] = token

    def run(text: str) -> tuple[np.ndarray, bytes]:
        ids = own.encode_ordinary(text)
        return np.array(ids, dtype="<u4"), b"".join(map(spelled.__getitem__, ids))

    return run


def boundaries(text: str, pattern: str, start: int, first: bool, last: bool, overlap: int) -> tuple[list[int], list[int]]:
    """Where a chunk's pre-tokens begin after a non-space and before an ASCII space: in its
    first ``overlap`` characters, and in its last. Positions count from the text's beginning.

    Every pre-token that holds white space after something else would contradict the
    pattern, so such a boundary, once two chunks share it, is one of the whole text.
    """
    import regex

    def real(p: int) -> bool:
        return 0 < p < len(text) and text[p] in " \t\n\r" and not text[p - 1].isspace()

    begins = regex.compile(pattern).finditer
    head = [] if first else [start + m.start() for m in begins(text, 0, overlap + 64) if m.start() < overlap and real(m.start())]
    tail = []
    if not last:
        # The tokens before the overlap don't matter: from a boundary on, tokens depend on what follows only.
        at = next((p for p in range(max(1, len(text) - overlap), len(text)) if real(p)), len(text))
        tail = [start + m.start() for m in begins(text, at) if m.start() <= len(text) - AHEAD and real(m.start())]
    return head, tail


def encode_rows(batches: Iterator[pa.RecordBatch], data: bytes, pattern: str, keep: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> token count, hashes of the ids and of the decoded bytes; ids too if ``keep``."""
    run = codec(data, pattern)
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep]
    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        for text in batch.column(1).to_pylist():
            ids, raw = run(text)
            row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), ids.tobytes())
            for column, value in zip(out, row, strict=False):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, out, kinds)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep],
        )


def encode_pieces(batches: Iterator[pa.RecordBatch], data: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    """Adds ``ids`` (little-endian unsigned 32-bit) and ``raw`` (decoded bytes) to rows whose last column is ``text``."""
    run = codec(data, pattern)
    for batch in batches:
        done = [run(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([i.tobytes() for i, _ in done], pa.binary()), pa.array([r for _, r in done], pa.binary())],
            names=[*batch.schema.names[:-1], "ids", "raw"],
        )


def chunk_pieces(rows: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Texts as pieces (key, piece, text) that begin and end at pre-token boundaries of the whole text.

    ``rows`` has (key, text). Chunks of ``chunk`` characters, each with ``overlap`` more, are
    pre-tokenised one by one; neighbours are stitched at the first boundary both have in
    their overlap. Chunks without a shared boundary become one piece with those before.
    """
    chunks = (
        rows.withColumn("n", F.char_length("text"))
        .select("key", "n", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))).alias("start"))
        .select("key", "start", "n", F.substr("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("text"))
        .repartition("key", "start")
    )

    def split(batches):
        for batch in batches:
            start, n, texts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            ends = [
                boundaries(t, pattern, s, s == 0, s + chunk + overlap >= total, overlap)
                for s, total, t in zip(start, n, texts, strict=True)
            ]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t[:chunk] for t in texts], pa.string()),
                 pa.array([h for h, _ in ends], kind), pa.array([t for _, t in ends], kind)],
                names=["key", "start", "text", "head", "tail"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    found = chunks.mapInArrow(split, f"key {kind}, start int, text string, head array<int>, tail array<int>")
    order = Window.partitionBy("key").orderBy("start")
    cut = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    stitched = (
        found.withColumn("cut", cut)
        .withColumn("run", F.count("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("at", F.col("cut") - F.col("start"))
    )
    parts = F.when(
        F.col("cut").isNull(), F.array(F.struct(F.col("run").alias("piece"), F.col("text").alias("part")))
    ).otherwise(
        F.array(
            F.struct((F.col("run") - 1).alias("piece"), F.substr("text", F.lit(1), F.col("at")).alias("part")),
            F.struct(F.col("run").alias("piece"), F.substr("text", F.col("at") + 1).alias("part")),
        )
    )
    return (
        stitched.select("key", "start", F.explode(parts).alias("p"))
        .groupBy("key", "p.piece")
        .agg(F.sort_array(F.collect_list(F.struct("start", "p.part"))).alias("parts"))
        .select("key", "piece", F.array_join(F.col("parts.part"), "").alias("text"))
    )


def encode_long(rows: DataFrame, data: bytes, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Long texts: pieces are encoded apart, then joined per text. A row of ``rows`` is told apart by ``key``."""
    pieces = chunk_pieces(rows.select("key", "text"), pattern, chunk, overlap)
    kind = rows.schema["key"].dataType.simpleString()

    def encode(batches):
        return encode_pieces(batches, data, pattern)

    def whole(name: str):
        parts = F.sort_array(F.collect_list(F.struct("piece", name)))
        return F.aggregate(F.transform(parts, lambda p: p[name]), F.lit(b""), lambda a, b: F.concat(a, b))

    return (
        pieces.mapInArrow(encode, f"key {kind}, piece long, ids binary, raw binary")
        .groupBy("key")
        .agg(whole("ids").alias("ids"), whole("raw").alias("raw"))
    )


def encode_texts(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    chunk: int = 65_536,
    overlap: int = 1_024,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Every text encoded by the ranks in ``rank_path``, and decoded again.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row, and with
    ``keep_ids`` the ids as little-endian unsigned 32-bit numbers. Null and
    empty texts have no tokens. Texts of up to ``chunk`` characters are one chunk and stay
    in their task; longer ones are cut, stitched and encoded as rows of their own, each different
    text once, and the result goes to every row that has the text.
    """
    if overlap > chunk:
        raise ValueError("the overlap is longer than a chunk")
    data = vocabulary(rank_path)
    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    is_long = F.char_length("text") > chunk

    def encode(batches):
        return encode_rows(batches, data, pattern, keep_ids)

    made = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    short = rows.filter(~is_long).mapInArrow(encode, made)
    long = rows.filter(is_long).withColumn("key", F.sha2("text", 256))
    done = encode_long(long.dropDuplicates(["key"]), data, pattern, chunk, overlap).select(
        "key",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
        *["ids"] * keep_ids,
    )
    return short.unionByName(long.select("doc_id", "key").join(done, "key").drop("key"))
