"""Operators over the whole corpus against brute force: decontamination, SimHash, lines, shards, toxicity, pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from meterloom.llm import common, decontaminate as dc, line_dedup as ld, queries, sharding, simhash as sh, toxicity as tx
from tests.compare import compare, duck
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# ------------------------------------------------------------ decontamination


def plain_hits(docs, items, width=13):
    windows = {}
    for name, text in items:
        words = WORD.findall(lowered(text))
        n = min(width, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(name))
    out = {}
    for d, text in docs:
        words, hit, names = WORD.findall(lowered(text)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    names |= found
        out[d] = (len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out


def test_hits_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op1_decontaminate(spark, SF).collect()}
    expected = plain_hits(docs, items)
    assert found == expected and any(v[4] for v in expected.values())


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_hits_on_few_words(spark, frame, block_bytes):
    """Few different words: long postings, overlapping windows, short and repeated items."""
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice(["A", "b", "é", "the", "7"]) for _ in range(n))
    texts = [some(rng.randrange(0, 60)) for _ in range(60)]
    items = [(i, some(n)) for i, n in enumerate([3, 5, 1, 4, 2, 6, 5])] + [(90, texts[4] + " the"), (91, texts[9][4:]), (92, ""), (93, None), (94, "?!")]
    docs = frame(texts)
    index = dc.build_index(docs, shard_bytes=400)
    assert index.count() > 3
    found = dc.judged(dc.search(index, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes))
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in found.collect()}
    assert got == plain_hits(list(enumerate(texts)), items)


def test_near_items(spark, frame):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = frame([item, item.replace("delta", "delta or so"), "alpha beta gamma", item.replace(" ", " x x x ")])
    found = {r.doc_id: r for r in dc.search(dc.build_index(docs), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert [found[i]["items"] for i in range(4)] == [["5"], [], [], []]
    assert found[0].near_items == found[1].near_items == ["5"] and found[2].near_items == found[3].near_items == []
    assert [tuple(s) for s in found[0].spans] == [(0, 13)]


def test_decontamination_of_awkward_rows(spark, awkward, no_docs):
    items = spark.createDataFrame([(1, "end of the long text"), (None, "a"), (2, None)], "item_id long, text string")
    found = dc.judged(dc.search(dc.build_index(awkward), items)).collect()
    assert len(found) == awkward.count()
    by_id = {r.doc_id: r["items"] for r in found if r.doc_id in (3, 4, 0, 13)}
    assert by_id == {3: ["1"], 4: ["null"], 0: [], 13: ["null"]}
    assert dc.search(dc.build_index(no_docs), items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.judged(dc.search(dc.build_index(awkward), none)).filter("contaminated").count() == 0
    assert dc.without_contaminated(awkward, items).columns == awkward.columns


# ------------------------------------------------------------ SimHash


def plain_simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def plain_groups(prints):
    """doc_id -> smallest doc_id reachable; prints: doc_id -> fingerprint."""
    ids = sorted(prints)
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: root(i) for i in ids}


def test_every_close_pair_shares_a_table():
    masks = sh.masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not (1 << i | 1 << j) & m for m in masks)


def test_groups_on_the_tables(spark):
    prints = {r.doc_id: plain_simhash(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    groups = plain_groups(prints)
    found = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SF).collect()}
    assert found == {(d, f"{f:016x}", groups[d]) for d, f in prints.items()}


@pytest.mark.parametrize("small", [64, 2])
def test_links_of_crowded_buckets(spark, small):
    """Many fingerprints a bit or two apart, with small buckets paired or none."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {}
    for c in centres:
        for _ in range(30):
            f = c
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                f ^= 1 << b
            prints[len(prints)] = f
    rows = spark.createDataFrame([(sh.signed(f),) for f in set(prints.values())], "fingerprint long")
    linked = {r.node: r.component for r in common.components(sh.near_links(rows, small=small)).collect()}
    groups = plain_groups(prints)
    label = {}
    for d, f in prints.items():
        label.setdefault(linked.get(sh.signed(f), sh.signed(f)), set()).add(groups[d])
    assert all(len(g) == 1 for g in label.values()) and len(label) == len(set(groups.values()))


def test_long_chain(spark):
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = common.components(links)
    assert found.count() == 401 and found.select("component").distinct().collect()[0][0] == 0
    assert common.components(links.limit(0)).count() == 0


def test_groups_of_awkward_rows(awkward, no_docs, frame):
    found = sh.near_groups(awkward)
    assert found.count() == awkward.count()
    by_id = {r.doc_id: r.component_id for r in found.collect() if r.doc_id is not None}
    assert by_id[1] == by_id[2] == by_id[0] == 0  # null, empty and blank: no words
    assert sh.near_groups(no_docs).count() == 0 and sh.one_of_each(no_docs).count() == 0
    kept = sh.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.filter("doc_id = 11").count() == 1
    again = sh.one_of_each(frame([(7, "some words in here"), (7, "some words in here"), (3, "some words in here"), (9, "quite another text")]))
    assert sorted(r.doc_id for r in again.collect()) == [3, 9]


# ------------------------------------------------------------ lines


def apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_lines(docs):
    """(doc_id, line) -> 'exact' or 'near' for the lines to remove; ids are different."""
    lines = [((d, j), tuple(line.split())) for d, t in docs for j, line in enumerate((t or "").split("\n"))]
    lines = sorted((p, w) for p, w in lines if w)
    first = {}
    for p, w in lines:
        first.setdefault(w, p)
    near, ends = set(), {}
    for w, p in sorted(first.items(), key=lambda x: x[1]):
        # Lines one word apart share their first two words or their last two.
        if len(w) >= 5:
            for key in (("a", w[:2]), ("z", w[-2:])):
                if w not in near and any(abs(len(v) - len(w)) <= 1 and apart(w, v) <= 1 for v in ends.get(key, ())):
                    near.add(w)
                ends.setdefault(key, []).append(w)
    return {p: "near" if w in near else "exact" for p, w in lines if w in near or first[w] != p}


def found_lines(df):
    return {(r.doc_id, i): k for r in df.collect() for k in ("exact", "near") for i in r[k]}


def test_one_word_apart():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(0, 7))] for _ in range(2))
        assert ld.one_word_apart(a, b) == (apart(a, b) <= 1)


def test_close_lines_share_a_key_and_a_variant():
    rng = random.Random(5)
    for _ in range(2000):
        a = [rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(5, 40))]
        b, i = list(a), rng.randrange(len(a))
        b[i : i + rng.randrange(2)] = [rng.choice([b"x", b"q"])] * rng.randrange(2)
        if len(b) < 5 or a == b:
            continue
        assert {k for k in ld.keys_of(a) if k is not None} & set(ld.keys_of(b))
        (va, wa), (vb, wb) = ld.variants(a), ld.variants(b)
        assert wa in vb or wb in va or any(va == vb if len(va) == len(vb) else [])


def test_lines_against_all_pairs(frame):
    rng = random.Random(6)
    lines = [" ".join(rng.choice(["un", "deux", "trois", "é"]) for _ in range(rng.randrange(0, 9))) for _ in range(90)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 8))) for _ in range(40)]
    assert found_lines(ld.repeated_lines(frame(texts))) == plain_lines(list(enumerate(texts)))


def test_lines_on_the_tables(spark, small):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    expected = plain_lines(docs)
    assert found_lines(ld.repeated_lines(small)) == expected and "near" in expected.values()
    texts = {r.doc_id: r.text for r in ld.dedupe_lines(small).collect()}
    assert texts == {d: "\n".join(x for j, x in enumerate(t.split("\n")) if (d, j) not in expected) for d, t in docs}
    for r in queries.op8_line_dedup(spark, SF).collect():
        gone = sorted(j for d, j in expected if d == r.doc_id)
        assert r.removed == ",".join(map(str, gone)) and r.n_exact + r.n_near == len(gone)


def test_lines_of_awkward_rows(awkward, no_docs, frame):
    kept = ld.dedupe_lines(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert {r.doc_id: r.text for r in kept.collect() if r.doc_id in (0, 1, 2, 12)} == {0: None, 1: "", 2: " \n\t ", 12: "\n\n\n"}
    assert ld.dedupe_lines(no_docs).count() == 0 and ld.repeated_lines(no_docs).count() == 0
    docs = frame(["one line of five words here", "one line of five words here", "", None, "keep\none line of five words there"])
    assert {r.doc_id: r.text for r in ld.dedupe_lines(docs, drop_emptied=True).collect()} == {0: "one line of five words here", 2: "", 3: None, 4: "keep"}
    twice = frame([(1, "the same row"), (1, "the same row")])
    assert [r.text for r in ld.dedupe_lines(twice).collect()] == ["the same row"] * 2


# ------------------------------------------------------------ shards


def test_shards_equal_sql(spark):
    same, found, expected, diff, names = compare(spark, duck("/root/testdata/sf0.01"), "/root/testdata/sf0.01", queries.op5_shards, queries.ORACLES["op5_shards"])
    assert same, names
    assert found == expected, diff


@pytest.mark.parametrize("limit", [1, 300, 5000, 10**9])
def test_shards_fit(small, limit):
    rows = sharding.extendible_shards(small, limit).collect()
    assert len(rows) == small.count()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.n_bytes
    n = Counter(r.shard for r in rows)
    for r in rows:
        assert (sums[r.shard], n[r.shard]) == (r.shard_bytes, r.shard_rows) and (r.shard_bytes <= limit or r.shard_rows == 1)
        # No shard lies within another, and one that has been split was too large as a whole.
        parent = r.shard[:-1]
        assert not r.shard or sum(b for s, b in sums.items() if s.startswith(parent)) > limit
        assert not any(r.shard[:k] in sums for k in range(len(r.shard)))


def test_shards_of_one_id(frame):
    """A hot id splits on the text, and repeated rows on their row number."""
    docs = frame([(1, f"text {i % 20}") for i in range(200)])
    rows = sharding.extendible_shards(docs, 50).collect()
    assert len(rows) == 200 and all(r.shard_bytes <= 50 for r in rows) and max(r.depth for r in rows) > 120


def test_shards_of_awkward_rows(awkward, no_docs, tmp_path, spark):
    rows = sharding.extendible_shards(awkward, 1000, keep=("lang",)).collect()
    assert len(rows) == awkward.count() and all(r.shard_bytes <= 1000 or r.shard_rows == 1 for r in rows)
    assert sharding.extendible_shards(no_docs, 10).count() == 0
    with pytest.raises(ValueError):
        sharding.extendible_shards(no_docs, 0)
    docs = awkward.select("doc_id", "text", "lang")
    sharding.write_shards(docs, 70_000, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == docs.count() and back.select("shard").distinct().count() > 2


# ------------------------------------------------------------ toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op9_toxicity(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    caught = sum(r.predicted for r in rows if r.toxic) / sum(1 for r in rows if r.toxic)
    false = sum(r.predicted for r in rows if not r.toxic) / sum(1 for r in rows if not r.toxic)
    # Some 350 toxic rows to learn from here, and some labelled toxic without any term that others share.
    assert caught > 0.85 and false < 0.02, (caught, false)


def test_held_out_labels_are_not_learned_from(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(tx.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in tx.toxicity(small, x).collect()) for x in (labels, turned))
    assert a == b


def test_sample_has_an_id_once(spark):
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(ids[0], f"text {k:03}") for k in range(500)] + [(i, "other") for i in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 0), (ids[0], 1), (ids[1], 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, tx.training_sample(docs, labels, 10).collect())) == [("other", 0), ("text 000", 1)]


def test_label_model_finds_rates_and_correlations():
    import numpy as np

    rng = np.random.default_rng(0)
    n, prior = 40_000, 0.2
    toxic = rng.random(n) < prior
    truth = [(0.02, 0.7), (0.1, 0.6), (0.01, 0.4), (0.05, 0.8), (0.03, 0.5), (0.04, 0.6)]
    votes = np.stack([np.where(toxic, rng.random(n) < p1, rng.random(n) < p0) for p0, p1 in truth], axis=1).astype(float)
    votes = np.column_stack([votes, votes[:, 5]])  # a copy of the last voter
    rates, linked = tx.label_model(n, votes.sum(axis=0), votes.T @ votes, prior)
    assert np.abs(rates[:5] - np.array(truth[:5])).max() < 0.08
    assert [(i, j) for i, j, _ in linked] == [(5, 6)]


def test_toxicity_of_awkward_rows(spark, awkward, no_docs, small):
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 1), (3, 1, None), (11, 1, 1), (11, 1, 1)], "doc_id long, quality int, toxic int")
    found = tx.toxicity(awkward, labels).collect()
    assert len(found) == awkward.count() and all(0 <= r.score <= 1 for r in found)
    assert tx.toxicity(no_docs, labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in tx.toxicity(small, none).collect()} == {0.0}
    assert tx.without_toxic(awkward, none).columns == awkward.columns


# ------------------------------------------------------------ pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = common.stored(stage(spark, docs, SF), "test-stage")
        assert docs.dtypes == documents.dtypes, name
        seen[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs.collect()})
    before, after = seen["line dedup"]
    gone = plain_lines(list(before.items()))
    left = {d: "\n".join(x for j, x in enumerate(t.split("\n")) if (d, j) not in gone) for d, t in before.items()}
    assert after == {d: t for d, t in left.items() if t.strip() or not before[d].strip()}
    before, after = seen["SimHash near-dedup"]
    groups = plain_groups({d: plain_simhash(t) for d, t in before.items()})
    assert after == {d: t for d, t in before.items() if groups[d] == d}
    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = plain_hits(list(before.items()), items)
    assert after == {d: t for d, t in before.items() if not judged[d][4]}
    rows = cp.run(spark, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in after.items()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)


def test_pipeline_of_awkward_rows(spark, awkward, no_docs, tmp_path):
    import corpus_pipeline as cp

    for name, docs in (("awkward", awkward.drop("n_tokens")), ("none", no_docs)):
        sf = f"{tmp_path}/{name}"
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        found = cp.run(spark, sf)
        assert "n_tokens" in found.columns and (found.count() > 5) == (name == "awkward")
