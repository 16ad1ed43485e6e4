"""Awkward tables that every text operator must take."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "end of the long text."


def rows_of(texts, start=0):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts, start)]


@pytest.fixture(scope="session")
def frame(spark):
    """Texts to a documents table; a text may be a (doc_id, text) pair."""

    def make(texts, parts=2):
        rows = [
            (t[0], t[1], "en", "s", None) if isinstance(t, tuple) else (i, t, "en", "s", None) for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def awkward(frame):
    """Nulls in every column, empty, blank and very long texts, repeated rows, one id with two
    texts, and extra columns named as helper columns are."""
    texts = [
        None, "", " \n\t ", LONG, "a", "naïve Ünïcödé 日本語 😀 text", "x" * 70_000, (None, "no id here at all"), (None, None),
        (4, "a"), (5, "another text of the same id"), "mail me: a@b.co or +1 (555) 010-0000 \r\n twice", "\n\n\n", "▁ ▁▁ a  b   c ",
    ]
    extra = {c: F.lit(c) for c in ("row", "key", "kind", "spans", "place", "line", "score", "n_tokens", "text2", "uid", "shard", "bucket", "extra", "fingerprint", "node", "a", "b", "h1", "h2", "__own")}
    df = frame(texts).withColumns({**extra, "lang": F.lit(None).cast("string")})
    return df.unionByName(df.filter("doc_id = 11"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
