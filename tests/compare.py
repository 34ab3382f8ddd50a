"""Holds the result of a registered query against that of its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(row[i]) for i in order)) for row in rows)


def difference(con, spark_df, sql: str, limit: int = 3) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(columns)}"
    expected = rows_of(columns, result.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got == expected:
        return None
    extra, missing = _minus(got, expected), _minus(expected, got)
    return f"rows {len(got)} against {len(expected)}\n  only spark: {extra[:limit]}\n  only sql: {missing[:limit]}"


def _minus(a, b):
    from collections import Counter

    return list((Counter(a) - Counter(b)).elements())
