"""Compare a Spark result with DuckDB on the same Parquet files."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0 if value != 0 else 0.0)
    return str(value)


def rows(names, data) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(canonical(r[k]) for k in order) for r in data)


def compare(spark_df, con, sql: str) -> tuple[int, list]:
    """Row count and the first differing rows (empty when equal)."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    got_names = spark_df.columns
    assert sorted(got_names) == sorted(names), (sorted(got_names), sorted(names))
    got = rows(got_names, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(want):
        return len(got), [("rows", len(got), len(want)), got[:3], want[:3]]
    return len(got), [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3]
