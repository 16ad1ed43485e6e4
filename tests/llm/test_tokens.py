"""Token counts and byte-level BPE against the libraries on whole texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from meterloom.llm import bpe, token_counts
from meterloom.llm.queries import PIECES, RANKS


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))


@pytest.fixture(scope="module")
def own():
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=120):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n \n", "\t", "the", "Straße", "'re", "'", "don't", "12345", "...", "日本", "😀", "▁", "<s>", " ", " ", "é", "x" * 40, "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def expect_pieces(pieces, docs):
    return sorted((r.doc_id, len((r.text or "").encode()), len(pieces.encode(r.text or "")), len(pieces.encode(r.text or "")) > 4096) for r in docs.collect())


def test_counts(frame, small, pieces):
    for docs in (frame(texts()), small):
        found = token_counts.token_counts(docs, public_tokenizers.path(PIECES), batch_bytes=2000, memory=5000)
        assert sorted(map(tuple, found.collect())) == expect_pieces(pieces, docs)


def test_counts_of_awkward_rows(awkward, no_docs, pieces):
    found = token_counts.token_counts(awkward, public_tokenizers.path(PIECES))
    key = lambda r: (r[0] is not None, r)
    expected = [
        (r.doc_id, len((r.text or "").encode()), n := len(pieces.encode(r.text or "")), n > 4096) for r in awkward.collect()
    ]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    assert token_counts.token_counts(no_docs, public_tokenizers.path(PIECES)).count() == 0


def test_model_without_safe_places():
    assert token_counts.crossing_pieces(["▁a", "a▁b", "▁▁"]) == ["a▁b"]


def expect_bpe(own, docs):
    out = []
    for r in docs.collect():
        ids = own.encode_ordinary(r.text or "")
        out.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk,overlap", [(65_536, 1024), (40, 12), (12, 12)])
def test_bpe_with_any_chunk(frame, small, own, chunk, overlap):
    docs = frame(texts()) if chunk < 100 else small
    found = bpe.encode_texts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, chunk, overlap)
    assert sorted(map(tuple, found.collect())) == sorted(expect_bpe(own, docs))


def test_bpe_of_awkward_rows(awkward, no_docs, own):
    key = lambda r: (r[0] is not None, r)
    found = bpe.encode_texts(awkward, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expect_bpe(own, awkward), key=key)
    assert bpe.encode_texts(no_docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).count() == 0


def test_pieces_meet_at_boundaries(frame):
    docs = frame(["one two  three\nfour " * 20])
    rows = docs.select(docs.doc_id.alias("key"), "text")
    parts = sorted(map(tuple, bpe.chunk_pieces(rows, public_tokenizers.PATTERN, 50, 20).collect()))
    assert len(parts) > 3 and "".join(t for _, _, t in parts) == "one two  three\nfour " * 20
    assert all(t[0] in " \n" for _, _, t in parts[1:])


def test_overlap_within_chunk(no_docs):
    with pytest.raises(ValueError):
        bpe.encode_texts(no_docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, 10, 11)
