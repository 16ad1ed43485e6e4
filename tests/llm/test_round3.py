"""Block naming, hard negatives and collocations against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import block_names as bn, collocations as co, hard_negatives as hn, queries
from tests.compare import compare, duck
from tests.llm.conftest import SCHEMA, SF


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_exact_dedup", "op13_collocations"])
def test_same_as_sql(spark, name):
    same, ours, theirs, diff, _ = compare(spark, duck(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
    assert same and ours == theirs, diff
    assert ours


# ------------------------------------------------------------ block naming


def plain_groups(rows):
    """(doc_id, keep_id, group_size, sha) as sorted rows; a null id is the smallest."""
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes,shard_bytes", [(1, 30), (3, 50), (7, 1 << 20), (1024, 400)])
def test_groups_of_texts(frame, block_bytes, shard_bytes):
    """Texts that share blocks, prefixes and halves, of every length around powers of two."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbÉ") for _ in range(rng.randrange(0, 20))) for _ in range(150)]
    texts += ["ab" * n for n in range(40)] + ["ab" * n + "a" for n in range(40)] + ["AB" * 32, None, "", "é", "É"]
    rows = list(enumerate(texts))
    found = bn.exact_groups(frame(texts, parts=5), block_bytes=block_bytes, shard_bytes=shard_bytes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == plain_groups(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_groups_of_awkward_rows(awkward, no_docs):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    found = bn.exact_groups(awkward, block_bytes=16).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == plain_groups(rows)
    assert sum(r.kept for r in found) == len({lowered(t) for _, t in rows})  # one of each, also of rows alike
    kept = bn.without_copies(awkward, block_bytes=16)
    assert kept.columns == awkward.columns
    assert sorted(lowered(r.text) for r in kept.collect()) == sorted({lowered(t) for _, t in rows})
    assert bn.exact_groups(no_docs).isEmpty() and bn.without_copies(no_docs).isEmpty()


def test_groups_with_text_ids(spark):
    docs = spark.createDataFrame([("a", "X"), ("b", "x"), (None, "x"), ("c", "y")], "doc_id string, text string")
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in bn.exact_groups(docs).collect()}
    assert found == {("a", "b", 3, False), ("b", "b", 3, True), (None, "b", 3, False), ("c", "c", 1, True)}


# ------------------------------------------------------------ hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 70), (65, 67, 129), (5, 200, 3), (40, 40, 40)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    a, b = rng.integers(-(1 << 25), 1 << 25, (m, k)), rng.integers(-(1 << 25), 1 << 25, (k, n))
    assert (hn.strassen(a, b, least=2) == a @ b).all() and (hn.strassen(a, b) == a @ b).all()


def plain_negatives(rows, is_anchor, n=5):
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        usable[i] = min(usable.get(i, (label, q)), (label, q))
    out = set()
    for a, (label, q) in usable.items():
        if not is_anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, w)) for i, (_, w) in usable.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if usable[i][0] == label][:n]:
            fit = [i for i in order if usable[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:n]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(fit, 1)}
    return out


def found_negatives(df):
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()}


def test_negatives_with_ties_and_odd_rows(spark):
    """Few values, so many scores tie; tiles of a few rows; vectors of several lengths; rows that take no part."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(rng.choice([4, 4, 4, 3]))]) for i in range(300)]
    rows += [(7, 0, [0.25] * 4), (9, None, [1.0]), (1000, 1, None), (1005, 1, [1.0, None]), (1010, 1, [float("nan")]), (1015, 2, [float("inf")])]
    rows += [(1020, 1, []), (None, 1, [1.0] * 4), (10, *rows[10][1:]), (1025, 77, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    for c in ("id", "q", "anchor", "tile", "group", "rank", "score", "extra"):
        df = df.withColumn(c, F.lit(c))
    df = df.repartition(4)
    found = hn.hard_negatives(df, F.col("vec_id") % 5 == 0, anchor_rows=16, candidate_rows=32)
    expected = plain_negatives(rows, lambda i: i % 5 == 0)
    assert found_negatives(found) == expected and len(expected) > 500
    assert found.count() == len(expected)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hn.hard_negatives(empty, F.col("vec_id") % 100 == 0).isEmpty()
    lone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hn.hard_negatives(lone, F.col("vec_id") % 100 == 0).isEmpty()


def test_components_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, 1, [1e30, 1.0]), (1, 1, [1e30, 1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        hn.hard_negatives(df, F.col("vec_id") == 0).collect()


# ------------------------------------------------------------ collocations


def plain_collocations(rows, support=10, longest=3, most=2000, absorbed=50):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    chosen = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= support}
    out = set()
    for lang in n:
        rows = []
        for (own, w), a in chosen.items():
            if own != lang or any(
                o == lang and len(v) > len(w) and 100 * b >= absorbed * a and any(v[i : i + len(w)] == w for i in range(len(v)))
                for (o, v), b in chosen.items()
            ):
                continue
            score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:most], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def found_collocations(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("longest,shards,block_bytes,support", [(3, 4, 300, 10), (2, 1, 1 << 20, 3), (4, 7, 100, 6)])
def test_phrases_of_few_words(spark, longest, shards, block_bytes, support):
    rng = random.Random(longest)
    words = ["a", "B", "c", "É", "日本", "new", "york", "\x01", "a-b", "\xa0"]
    rows = [
        (rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ","]) for _ in range(rng.randrange(60))))
        for _ in range(150)
    ] + [("en", None), ("fr", ""), (None, " \t"), ("en", "new york " * 400)]
    docs = spark.createDataFrame([(i, t, lang, "s", None) for i, (lang, t) in enumerate(rows)], SCHEMA)
    docs = docs.withColumns({c: F.lit("x") for c in ("phrase", "h", "f", "words", "n", "part", "a", "l", "r", "rank")}).repartition(4)
    found = co.collocations(docs, support, longest, most=50, shards=shards, block_bytes=block_bytes)
    expected = plain_collocations(rows, support, longest, most=50)
    assert found_collocations(found) == expected and len(expected) > 60


def test_lowered_support_misses_nothing(spark, small):
    """Candidates of the shards hold every phrase that is frequent in all."""
    parts = co.blocks(small.repartition(6), 40_000)
    shares = dict(parts.groupBy(F.col("part") % 3).agg(F.sum("n_words")).collect())
    supports = {s: -(-30 * shares.get(s, 0) // sum(shares.values())) for s in range(3)}
    assert sum(supports.values()) <= 32
    mined = {r.h for r in co.mined(parts, 2, [], supports).collect()}
    frequent = {r.h for r in co.hashed(co.counts(parts, 2, []).filter("f >= 30")).collect()}
    everything = {r.h for r in co.hashed(co.counts(parts, 2, [])).collect()}
    assert len(everything) == co.counts(parts, 2, []).count()
    assert frequent and frequent <= mined < everything


def test_phrases_of_awkward_rows(awkward, no_docs):
    found = found_collocations(co.collocations(awkward, support=2))
    assert found == plain_collocations([(r.lang, r.text) for r in awkward.collect()], support=2)
    assert any(r[2] == "word word" for r in found) or any(r[2] == "word word word" for r in found)
    assert co.collocations(no_docs).isEmpty()
