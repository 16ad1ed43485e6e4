"""Near copies of the pipeline against all pairs of texts."""

import random

import pytest

from meterloom.llm import near_texts as nt, simhash as sh


def plain_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_firsts(texts, least=0.8):
    """Numbers of the texts that are first of a group; links: 2 bits of SimHash, or ``least`` of all shingles."""
    marks, prints, top = [plain_shingles(t) for t in texts], [sh.simhash(t) for t in texts], list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(marks[i] & marks[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or both and both >= least * len(marks[i] | marks[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i for i in range(len(texts)) if root(i) == i}


def made(rng, n=150):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def changed(rng, words, edits):
    out = list(words)
    for i in rng.sample(range(len(out)), edits):
        out[i] = "new%d" % rng.randrange(10**6)
    return out


def test_stage_drops_near_copies_beyond_two_bits(spark, frame):
    import corpus_pipeline as cp

    rng = random.Random(8)
    texts = []
    for _ in range(12):
        words = made(rng)
        # Two words changed: some 0.88 of the shingles shared. Five: some 0.7.
        texts += [" ".join(words), " ".join(changed(rng, words, 2)), " ".join(changed(rng, words, 5))]
    assert any((sh.simhash(texts[i]) ^ sh.simhash(texts[i + 1])).bit_count() > 2 for i in range(0, 36, 3))
    kept = {r.doc_id for r in cp.drop_near_copies(spark, frame(texts), "").collect()}
    assert kept == plain_firsts(texts) and not kept & set(range(1, 36, 3))


@pytest.mark.parametrize("small", [64, 2])
def test_groups_against_all_pairs(frame, small):
    """A crowd of copies around some texts, with all buckets paired or only the smallest."""
    rng = random.Random(9)
    texts = ["", "two words", "Two  words", "two other words"]
    for _ in range(4):
        words = made(rng, 80)
        texts += [" ".join(changed(rng, words, rng.randrange(3))) for _ in range(25)]
    rng.shuffle(texts)
    kept = {r.doc_id for r in sh.one_of_each(frame(texts), alike=0.8, small=small).collect()}
    assert kept == plain_firsts(texts) and 6 < len(kept) < 60


def test_signatures_meet():
    rng, met = random.Random(10), 0
    for _ in range(300):
        words = made(rng, 200)
        (n, a, _), (_, b, _) = nt.signature(" ".join(words)), nt.signature(" ".join(changed(rng, words, 4)))
        assert n == len(plain_shingles(" ".join(words))) and len(a) == nt.BANDS
        met += bool(set(a) & set(b))
    assert met == 300
    assert nt.signature(" \n") == (0, [], []) and nt.signature("A b") == nt.signature("a  B")


def test_few_links_take_few_partitions(spark):
    """Rounds over a few links aren't spread over as many partitions as the input has."""
    from meterloom.llm.common import components

    rows = [(i + 1, i) for i in range(40)] + [(101, 100), (102, 100), (None, 3)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(64)
    found = components(links)
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}
    assert found.rdd.getNumPartitions() == 1
