"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Labelled training rows (a bounded sample) give terms: words and word beginnings that
   are much more frequent in toxic texts. They are dealt to lexicon voters; pattern voters
   look at form (shouting, symbols, repetition) and do not use labels.
2. The votes of *all* documents are counted, alone and in pairs, in one distributed pass.
   From these moments the label model estimates each voter's rates given the class, and
   which pairs agree more than the class explains (correlated voters count for less).
3. Posterior labels of the sample train a logistic regression on term and form features,
   which scores every document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from meterloom.llm.common import ship, text_rows, words_of

ship(__name__)

STEM = (3, 7)  # lengths of word beginnings, in bytes, from the first up to before the second
MARK = b"^"  # begins a term that stands for all words with this beginning

LEXICON_VOTERS = 16
PATTERNS = ("shouting", "symbols", "repeats", "short_words")
FORMS = 6  # form features of the classifier


def terms_of(word: bytes) -> list[bytes]:
    """A word as terms: itself and its beginnings."""
    return [word, *(MARK + word[:n] for n in range(STEM[0], min(STEM[1], len(word) + 1)))]


@dataclass
class Model:
    """What scoring needs; its size is bounded by the number of terms."""

    terms: dict[bytes, int] = field(default_factory=dict)
    heads: frozenset[bytes] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of term shares, hit count, votes, forms, constant
    prior: float = 0.5
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # P(vote | clean), P(vote | toxic)
    correlated: list[tuple[int, int, float]] = field(default_factory=list)


def forms_of(text: str, words: list[bytes]) -> list[float]:
    """Shares of a text that say how it is written."""
    n, w = max(1, len(text)), max(1, len(words))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n
    signs = sum(map(text.count, "!?*#$%&@")) / n
    different = len(set(words)) / w
    length = sum(map(len, words)) / w
    return [upper, signs, different, length / 10, math.log1p(len(words)) / 10, float(not words)]


def heads_of(terms: dict[bytes, int]) -> frozenset[bytes]:
    """First bytes of all terms: a word that begins otherwise has none of them."""
    return frozenset(t.removeprefix(MARK)[: STEM[0]] for t in terms)


def hits_of(words: list[bytes], terms: dict[bytes, int], heads: frozenset[bytes]) -> Counter:
    """Times each term occurs; a word counts for every term it has."""
    found: Counter = Counter()
    n = STEM[0]
    for word, k in Counter([w for w in words if w[:n] in heads]).items():
        for t in terms_of(word):
            i = terms.get(t)
            if i is not None:
                found[i] += k
    return found


def votes_of(hits: Counter, forms: list[float]) -> np.ndarray:
    """1: toxic by this voter; 0: nothing found. Term i belongs to lexicon voter i mod LEXICON_VOTERS."""
    votes = np.zeros(LEXICON_VOTERS + len(PATTERNS))
    for i in hits:
        votes[i % LEXICON_VOTERS] = 1
    upper, signs, different, length, *_ = forms
    votes[LEXICON_VOTERS:] = (upper > 0.3, signs > 0.05, different < 0.2, length < 0.3)
    return votes


def features_of(hits: Counter, votes: np.ndarray, forms: list[float], n_words: int, n_terms: int) -> np.ndarray:
    x = np.zeros(n_terms + 2 + len(votes) + FORMS + 1)
    for i, k in hits.items():
        x[i] = math.log1p(k)
    total = sum(hits.values())
    x[n_terms] = math.log1p(total)
    x[n_terms + 1] = min(1.0, 20 * total / max(1, n_words))
    x[n_terms + 2 : n_terms + 2 + len(votes)] = votes
    x[n_terms + 2 + len(votes) : -1] = forms
    x[-1] = 1
    return x


def contexts_of(words: list[bytes]) -> dict[bytes, int]:
    """Terms of a text, with a bit (of 63) for each word that stands before one of them."""
    found: dict[bytes, int] = {}
    for before, word in set(zip([b"", *words], words, strict=False)):
        bit = 1 << zlib.crc32(before) % 63
        for t in terms_of(word):
            found[t] = found.get(t, 0) | bit
    return found


def choose_terms(
    toxic: Counter, clean: Counter, contexts: dict[bytes, int], n_toxic: int, n_clean: int, most: int, odds: float = 20
) -> dict[bytes, int]:
    """Terms whose share of toxic texts is ``odds`` times that of clean ones or more, by number of
    toxic texts; none that another chosen term covers. A term is in three toxic texts and one in a
    hundred of them at least, and stands after about as many different words as it has texts:
    the words of a passage that was copied often stand after one."""
    good = []
    least_rows = max(3, math.ceil(0.01 * n_toxic))
    for t, k in toxic.items():
        rate = (clean[t] + 0.5) / (n_clean + 1)
        if contexts.get(t, 0).bit_count() >= max(3, min(k, 20) // 2) and k >= least_rows and (k + 0.5) / (n_toxic + 1) >= odds * rate and clean[t] <= 0.1 * k:
            good.append((-k, len(t), t))
    chosen: dict[bytes, int] = {}
    for _, _, t in sorted(good):
        word = t.removeprefix(MARK)
        if any(MARK + word[:n] in chosen for n in range(1, len(word) + 1)):
            continue
        chosen[t] = len(chosen)
        if len(chosen) >= most:
            break
    return chosen


def label_model(n: float, ones: np.ndarray, pairs: np.ndarray, prior: float) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """P(vote | class) and the correlated pairs, from counts of votes and of joint votes over ``n`` texts.

    If votes are independent given the class, cov(i, j) = prior (1 - prior) a_i a_j with
    a_i = P(vote | toxic) - P(vote | clean). The a are fitted to all pairs; pairs with the
    largest misfit are taken as correlated and left out, and the rest is fitted again.
    """
    m = len(ones)
    mean = ones / max(1.0, n)
    cov = pairs / max(1.0, n) - np.outer(mean, mean)
    scale = max(prior * (1 - prior), 1e-6)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    used = ~np.eye(m, dtype=bool)
    a = np.clip(np.sqrt(np.maximum(cov.mean(axis=1), 0) / scale), 0.01, 1)
    for _ in range(3):
        for _ in range(200):
            top = (cov * used) @ a
            under = (used * (a * a)[None, :]).sum(axis=1) * scale
            a = np.clip(0.5 * a + 0.5 * top / np.maximum(under, 1e-9), 0.0, 1.0)
        misfit = np.abs(cov - scale * np.outer(a, a)) / np.outer(spread, spread)
        used = ~np.eye(m, dtype=bool) & (misfit < 0.3)
        if used.sum() < m:  # too few pairs left to fit
            used = ~np.eye(m, dtype=bool)
            break
    rates = np.stack([np.clip(mean - prior * a, 1e-4, 0.999), np.clip(mean + (1 - prior) * a, 1e-3, 0.999)], axis=1)
    linked = [
        (i, j, float(min(1.0, misfit[i, j]))) for i in range(m) for j in range(i + 1, m) if not used[i, j]
    ]
    return rates, linked


def anchored(rates: np.ndarray, mean: np.ndarray, prior: float, votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Rates whose P(vote | clean) is not above what the labelled clean rows show; the rest of a
    voter's votes are then of toxic texts. Voters of different languages never agree, so their
    moments alone would call them weak."""
    clean = votes[toxic == 0]
    p0 = np.clip(np.minimum(rates[:, 0], (clean.sum(axis=0) + 1) / (len(clean) + 2)), 1e-4, 0.999)
    p1 = np.where(p0 < rates[:, 0], (mean - (1 - prior) * p0) / prior, rates[:, 1])
    return np.stack([p0, np.clip(p1, np.maximum(p0, 1e-3), 0.999)], axis=1)


def posterior(votes: np.ndarray, model: Model) -> np.ndarray:
    """P(toxic | votes), a row each; a voter shares its weight with those it is correlated with.

    A voter that finds nothing abstains: a toxic text has the words of its own language, and
    says nothing by lacking all others.
    """
    share = np.ones(votes.shape[1])
    for i, j, c in model.correlated:
        share[i] += c
        share[j] += c
    p0, p1 = model.accuracy[:, 0], model.accuracy[:, 1]
    sums = votes @ (np.log(p1 / p0) / share)
    return 1 / (1 + np.exp(-np.clip(sums + math.log(model.prior / (1 - model.prior)), -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, classes weighted equally."""
    toxic = max(float(y.sum()), 1e-9)
    clean = max(float((1 - y).sum()), 1e-9)
    weight = y * (len(y) / (2 * toxic)) + (1 - y) * (len(y) / (2 * clean))
    weight = np.minimum(weight, 50)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of up to ``most`` labelled rows that may be learned from, the same for the
    same tables. ids of the sample are broadcast: at most ``most`` rows, so other documents don't
    move. An id with several labels is toxic if one says so; of several texts it has the smallest,
    so that an id that very many rows share is one row of the sample."""
    ids = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    chosen = docs.join(F.broadcast(ids), "doc_id")
    return chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fit(rows: DataFrame, labels: DataFrame, most_rows: int, most_terms: int) -> Model:
    """``rows`` has (doc_id, text). Only sums and the bounded sample's features reach the driver."""
    sample = training_sample(rows, labels, most_rows)

    # Terms: texts of each class that have them; a task sends terms of toxic texts, with both counts.
    def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        around: dict[bytes, int] = {}
        n = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[toxic] += 1
                found = contexts_of(words_of(text))
                seen[toxic].update(found.keys())
                if toxic:
                    for t, bits in found.items():
                        around[t] = around.get(t, 0) | bits
        seen[0][b""], seen[1][b""] = n  # the empty term: number of texts
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(both, pa.binary()), *(pa.array([s[t] for t in both], pa.int64()) for s in (seen[1], seen[0])),
             pa.array([around.get(t, 0) for t in both], pa.int64())],
            names=["term", "toxic", "clean", "contexts"],
        )

    counted = (
        sample.mapInArrow(term_rows, "term binary, toxic long, clean long, contexts long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("contexts").alias("contexts"))
        .filter((F.col("toxic") >= 3) & (F.col("clean") <= 0.1 * F.col("toxic")) | (F.col("term") == b""))
        .orderBy((F.col("term") == b"").desc(), F.col("toxic").desc(), "term").limit(64 * most_terms + 1)
        .collect()
    )
    toxic = Counter({bytes(r.term): r.toxic for r in counted})
    clean = Counter({bytes(r.term): r.clean for r in counted})
    n_toxic, n_clean = toxic.pop(b"", 0), clean.pop(b"", 0)
    if not n_toxic or not n_clean:
        return Model()
    contexts = {bytes(r.term): r.contexts for r in counted}
    terms = choose_terms(toxic, clean, contexts, n_toxic, n_clean, most_terms)
    heads = heads_of(terms)
    prior = min(0.9, max(0.01, n_toxic / (n_toxic + n_clean)))
    model = Model(terms=terms, heads=heads, prior=prior)

    # Label model: votes of all documents, counted per task.
    def vote_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LEXICON_VOTERS + len(PATTERNS)
        n, ones, pairs = 0, np.zeros(m), np.zeros((m, m))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                v = votes_of(hits_of(words, terms, heads), forms_of(text, words))
                n += 1
                if v.any():
                    ones += v
                    pairs += np.outer(v, v)
        yield pa.RecordBatch.from_arrays([pa.array([[float(n), *ones, *pairs.ravel()]], pa.list_(pa.float64()))], names=["sums"])

    sums = (
        rows.select("text").mapInArrow(vote_sums, "sums array<double>")
        .select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    )
    values = np.array([r.v for r in sums])
    m = LEXICON_VOTERS + len(PATTERNS)
    rates, model.correlated = label_model(values[0], values[1 : m + 1], values[m + 1 :].reshape(m, m), prior)

    # Linear classifier on posterior labels of the sample.
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                forms = forms_of(text, words)
                hits = hits_of(words, terms, heads)
                votes = votes_of(hits, forms)
                made.append((votes, features_of(hits, votes, forms, len(words), len(terms))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.packbits(v.astype(bool)).tobytes() for v, _ in made], pa.binary()),
                 pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary()), batch.column(1)],
                names=["votes", "x", "toxic"],
            )

    got = sample.mapInArrow(rows_of, "votes binary, x binary, toxic int").toPandas()
    x = np.stack([np.frombuffer(b, dtype="<f4") for b in got["x"]]).astype(np.float64)
    votes = np.stack([np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:m] for b in got["votes"]]).astype(np.float64)
    mean = values[1 : m + 1] / max(1.0, values[0])
    model.accuracy = anchored(rates, mean, prior, votes, got["toxic"].to_numpy())
    model.weights = fit_linear(x, posterior(votes, model))
    return model


def score_text(text: str, model: Model) -> float:
    if not len(model.weights):
        return 0.0
    words = words_of(text)
    forms = forms_of(text, words)
    hits = hits_of(words, model.terms, model.heads)
    x = features_of(hits, votes_of(hits, forms), forms, len(words), len(model.terms))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ model.weights)))))


def scorer(model: Model):
    """A function of a text column that gives its score; the other columns stay in the JVM."""

    @pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([score_text(t, model) for t in texts], dtype="float64")

    return score


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    most_rows: int = 20_000,
    most_terms: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; ``labels`` has (doc_id, toxic).

    Null and empty texts are scored like others, by their form. Without labels of both
    classes every score is 0. ``most_rows`` bounds the labelled rows that are learned from;
    votes are counted over all documents.
    """
    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    score = scorer(fit(rows, labels, most_rows, most_terms))
    return rows.select("doc_id", held_out().alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_terms: int = 256) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more. Texts don't move: they are scored where they are read."""
    score = scorer(fit(text_rows(docs), labels, most_rows, most_terms))
    return docs.filter(score(F.coalesce("text", F.lit(""))) < 0.5)
