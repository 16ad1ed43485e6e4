"""Registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterloom.llm import (
    block_names, bpe, collocations, decontaminate, hard_negatives, line_dedup, lz_fingerprint, pii, secret_scan, sharding, simhash,
    token_counts, toxicity,
)
from meterloom.llm.common import count_of, joined_spans, table

SHARD_BYTES = 1 << 20
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf, "documents"))
    found = decontaminate.judged(decontaminate.search(index, table(spark, sf, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.array_join("near_items", ",").alias("near_items"),
    )


def op2_lz_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return lz_fingerprint.edit_check(table(spark, sf, "documents"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path(PIECES))


def op4_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *[count_of(k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def op5_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf, "documents"), SHARD_BYTES)


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf, "documents")).select(
        "doc_id", simhash.as_hex().alias("fingerprint"), "component_id"
    )


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n_exact, n_near, removed (numbers of the removed lines) for every document."""
    docs = table(spark, sf, "documents")
    gone = line_dedup.repeated_lines(docs)
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    found = own.alias("o").join(
        gone.alias("g"), F.col("o.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("o.row") == F.col("g.row")), "left"
    )
    none = F.array().cast("array<int>")
    exact, near = F.coalesce("exact", none), F.coalesce("near", none)
    return found.select(
        "o.doc_id",
        F.size(exact).cast("long").alias("n_exact"),
        F.size(near).cast("long").alias("n_near"),
        F.array_join(F.array_sort(F.array_union(exact, near)).cast("array<string>"), ",").alias("removed"),
    )


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_spans(table(spark, sf, "documents")))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return block_names.exact_groups(table(spark, sf, "documents"))


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_lz_fingerprint, op3_token_counts, op4_personal_data, op5_shards,
        op6_bpe, op7_simhash, op8_line_dedup, op9_toxicity, op10_secret_scan,
        op11_hard_negatives, op12_exact_dedup, op13_collocations,
    )
}

ORACLES: dict[str, str] = {
    "op5_shards": sharding.ORACLE.format(limit=SHARD_BYTES),
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_exact_dedup": block_names.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
