"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterloom.llm.common import by_bytes, ship, text_rows, vocabulary

ship(__name__)

#: A space after a character that is neither a space nor the model's space sign, not at the
#: end. No piece of the model has a space sign after another character, so no merge crosses
#: such a place, and the sign the model puts before a text stands for the space cut away.
SAFE = re.compile(r"(?<=[^ ▁]) (?=.)", re.DOTALL)


def crossing_pieces(pieces: list[str]) -> list[str]:
    """Pieces with a space sign after another character; SAFE holds for models without any."""
    return [p for p in pieces if re.search("[^▁]▁", p)]


def count_batches(batches: Iterator[pa.RecordBatch], model: bytes, batch_bytes: int, memory: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens) for batches of (doc_id, text).

    Texts are cut at safe places; the distinct cuts of about ``batch_bytes`` of text are
    encoded in one call, and their lengths are remembered up to ``memory`` characters.
    """
    import sentencepiece

    model_ = sentencepiece.SentencePieceProcessor(model_proto=model)
    if crossing_pieces([model_.id_to_piece(i) for i in range(model_.get_piece_size())]):
        raise ValueError("texts of this model can't be cut at spaces")
    lengths: dict[str, int] = {}
    held = 0

    def counted(texts: list[str]) -> list[int]:
        nonlocal held
        cuts = [SAFE.split(t) for t in texts]
        if held > memory:
            lengths.clear()
            held = 0
        new = list(set(chain.from_iterable(cuts)).difference(lengths))
        for part in by_bytes(new, batch_bytes):
            lengths.update(zip(part, map(len, model_.encode(part, num_threads=1)), strict=True))
            held += sum(map(len, part))
        return [sum(map(lengths.__getitem__, c)) for c in cuts]

    for batch in batches:
        counts: list[int] = []
        for texts in by_bytes(batch.column(1).to_pylist(), batch_bytes):
            counts.extend(counted(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
        )


def token_counts(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    batch_bytes: int = 4 << 20,
    memory: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every text by a sentencepiece model, as its library encodes whole texts.

    Returns (doc_id, n_bytes, n_tokens, over_limit); a row for each row, repeated or not.
    Null and empty texts have 0 bytes and tokens. No shuffle; a task holds one Arrow batch
    and the remembered cuts.
    """
    rows = text_rows(docs, id_col=id_col, text_col=text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    model = vocabulary(model_path)

    def count(batches):
        return count_batches(batches, model, batch_bytes, memory)

    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
