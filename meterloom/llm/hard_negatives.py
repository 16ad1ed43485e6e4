"""Hard negatives: exact integer scores of anchors and candidates by Strassen's multiplication on tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from meterloom.llm.common import ship, stored

ship(__name__)

#: Sides up to this are multiplied plainly.
LEAST_SIDE = 32
#: Rows of a tile, about.
ANCHOR_ROWS, CANDIDATE_ROWS = 512, 2048


def strassen(a: np.ndarray, b: np.ndarray, least: int = LEAST_SIDE) -> np.ndarray:
    """The product of two int64 matrices of any shape, by seven products of halves.

    Odd sides get a row or column of zeros. Sums and products of int64 wrap modulo 2**64,
    so the result is exact whenever it fits, whatever the sums in between.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= least:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    m2, k2, n2 = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m2, :k2], a[:m2, k2:], a[m2:, :k2], a[m2:, k2:]
    b11, b12, b21, b22 = b[:k2, :n2], b[:k2, n2:], b[k2:, :n2], b[k2:, n2:]
    p1 = strassen(a11 + a22, b11 + b22, least)
    p2 = strassen(a21 + a22, b11, least)
    p3 = strassen(a11, b12 - b22, least)
    p4 = strassen(a22, b21 - b11, least)
    p5 = strassen(a11 + a12, b22, least)
    p6 = strassen(a21 - a11, b11 + b12, least)
    p7 = strassen(a12 - a22, b21 + b22, least)
    out = np.empty((2 * m2, 2 * n2), dtype=np.int64)
    out[:m2, :n2] = p1 + p4 - p5 + p7
    out[:m2, n2:] = p3 + p5
    out[m2:, :n2] = p2 + p4
    out[m2:, n2:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def tile(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones filled with zeros."""
    lists = vectors.combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Scores of anchors and candidates, and the order of the candidates: by id."""
    right_order = np.argsort(right["id"].to_numpy(), kind="stable")
    width = int(max(max(t["q"].combine_chunks().value_lengths().to_numpy(), default=0) for t in (left, right)))
    a, b = tile(left["q"], width), tile(right["q"], width)[right_order]
    most = [max(int(x.max()), -int(x.min())) if x.size else 0 for x in (a, b)]
    if 100 * width * most[0] * most[1] >= 1 << 62:
        raise ValueError("components are too large for scores of 64 bits")
    return strassen(a, np.ascontiguousarray(b.T)), right_order


def best(found: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's first n allowed columns: higher scores first, then the earlier column."""
    least = np.iinfo(np.int64).min
    ranked = np.where(allowed, found, least)
    if found.shape[1] > 4 * n:
        # Only columns that reach a row's nth score can be among its first; all that tie with it stay in.
        bar = np.partition(ranked, found.shape[1] - n, axis=1)[:, found.shape[1] - n]
        rows, columns = np.nonzero(allowed & (ranked >= bar[:, None]))
    else:
        rows, columns = np.nonzero(allowed)
    order = np.lexsort((columns, -found[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < n], columns[place < n]


def _positives(n: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"anchor_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        found, order = scores(left, right)
        anchors, ids = left["id"].to_numpy(), right["id"].to_numpy()[order]
        labels = right["label"].to_numpy()[order]
        same = (left["label"].to_numpy()[:, None] == labels) & (anchors[:, None] != ids)
        r, c = best(found, same, n)
        return pa.table({"anchor_id": anchors[r], "id": ids[c], "score": found[r, c]})

    return cell


def _window(n: int, low: int, high: int):
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [[np.zeros(0, dtype=np.int64)] * 5]
        if left.num_rows and right.num_rows:
            found, order = scores(left, right)
            anchors, ids = left["id"].to_numpy(), right["id"].to_numpy()[order]
            other = left["label"].to_numpy()[:, None] != right["label"].to_numpy()[order]
            positives = left["positives"].combine_chunks()
            sizes, flat = positives.value_lengths().to_numpy(), positives.flatten()
            starts = np.cumsum(sizes) - sizes
            p_ids, p_scores = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k in range(max(sizes, default=0)):
                rows = np.nonzero(sizes > k)[0]
                at = starts[rows] + k
                p = p_scores[at][:, None]
                own = found[rows]
                inside = other[rows] & (low * p <= 100 * own) & (100 * own <= high * p)
                r, c = best(own, inside, n)
                parts.append([anchors[rows[r]], p_ids[at[r]], p_scores[at[r]], ids[c], own[r, c]])
        return pa.table({name: np.concatenate([p[i] for p in parts]).astype(np.int64) for i, name in enumerate(names)})

    return cell


def _first(rows: DataFrame, by: list[str], score: str, then: str, n: int) -> DataFrame:
    """The first n of each group with their rank; Spark trims groups in the map tasks before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), then))
    return rows.withColumn("rank", place).filter(F.col("rank") <= n)


def quantised(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(vector: str) -> Column:
    """The vector is there and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    anchor_rows: int = ANCHOR_ROWS,
    candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says which rows are anchors. An anchor's positives are its best rows of the same
    label; for each, the best rows of other labels whose score is within ``low`` to ``high``
    percent of the positive's are its negatives. Scores are inner products of floor(256 * x);
    higher comes first, then the smaller id.

    Rows without id, label or vector, or with a null, NaN or infinite component, take no part. Of
    rows that share an id one does, the least by label and vector. Shorter vectors count as filled
    with zeros. Components so large that a score might not fit in 64 bits are an error. An empty
    table gives no rows.

    Anchors and candidates are dealt to tiles by hash; a cell is one tile of each, multiplied in
    one task, and keeps the first few of each anchor. The set of anchors is met with all rows, in
    blocks: a candidate is sent once per anchor tile, an anchor once per candidate tile, never a
    pair. Positives are merged and stored first, then the cells are run again for the windows.
    """
    kept = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("v"), anchors.alias("anchor")
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    whole = kept.select("id", F.struct("label", quantised("v").alias("q"), "anchor").alias("r"))
    table = stored(whole.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*"), "vectors")
    n, n_anchors = table.agg(F.count("*"), F.count_if("anchor")).first()
    tiles, groups = n // candidate_rows + 1, n_anchors // anchor_rows + 1

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return df.withColumns({
            own: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"),
            other: F.explode(F.sequence(F.lit(0), F.lit(others - 1))),
        })

    def cells(left: DataFrame, run, schema: str) -> DataFrame:
        a = dealt(left, "group", groups, "tile", tiles).groupBy("group", "tile")
        own = table.select(*[F.col(x).alias(x) for x in ("id", "label", "q")])  # columns of their own, apart from the anchors'
        c = dealt(own, "tile", tiles, "group", groups).groupBy("group", "tile")
        return a.cogroup(c).applyInArrow(run, schema)

    chosen = table.filter("anchor").select("id", "label", "q")
    near = cells(chosen, _positives(positives), "anchor_id long, id long, score long")
    near = stored(_first(near, ["anchor_id"], "score", "id", positives), "positives")
    own = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    left = chosen.join(own, "id").select("id", "label", "q", "positives")
    found = cells(
        left, _window(negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    first = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return first.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The contract's query in SQL.
ORACLE = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5"""
