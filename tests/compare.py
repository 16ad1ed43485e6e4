"""Side-by-side run of a registered query in Spark and its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def compare(spark, con, sf, fn, sql):
    """(names equal, Spark rows, DuckDB rows, first differences)."""
    df = fn(spark, sf)
    spark_rows = rows_of(df.columns, [tuple(x) for x in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    duck_rows = rows_of(names, rel.fetchall())
    same_names = sorted(df.columns) == sorted(names)
    diff = []
    if same_names and spark_rows != duck_rows:
        only_s = sorted(set(spark_rows) - set(duck_rows))[:3]
        only_d = sorted(set(duck_rows) - set(spark_rows))[:3]
        diff = [("columns", sorted(df.columns)), ("spark", only_s), ("duck", only_d)]
    return same_names, spark_rows, duck_rows, diff, (df.columns, names)
